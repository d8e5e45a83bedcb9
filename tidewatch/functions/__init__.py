"""Column-level functions (JVM expressions only; no Python UDFs)."""
