"""Incremental apply with Structured Streaming."""
