"""Structured Streaming forms of the stream operators."""
