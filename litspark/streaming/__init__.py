"""Structured Streaming counterparts of the log summaries and the change feed."""
