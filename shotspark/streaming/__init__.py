"""Structured Streaming entry points (file-stream session ingest)."""
