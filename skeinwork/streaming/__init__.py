"""Incremental ingest as a stream."""
