"""Structured Streaming form of the ingest chain."""
