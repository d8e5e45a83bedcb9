"""Readers and sinks of the moderation tables."""
