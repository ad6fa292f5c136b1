"""Incremental ingest of raw encounter files with Structured Streaming."""
