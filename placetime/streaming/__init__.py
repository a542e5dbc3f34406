"""Structured Streaming forms of the ingest dedup and the rolling counts."""
