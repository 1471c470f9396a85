"""Structured Streaming forms of ingest and status roll-ups."""
