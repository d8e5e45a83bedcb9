"""Registered queries: stand-in moderation tables derived from the driver
tables, the Spark query per operator, and the equivalent DuckDB SQL."""
