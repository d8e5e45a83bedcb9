"""DataFrame -> DataFrame operators of the moderation engine."""
