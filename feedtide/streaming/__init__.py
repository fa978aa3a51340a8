"""Structured Streaming forms of ingest, votes and timelines."""
