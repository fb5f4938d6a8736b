"""Structured Streaming forms of the counts."""
