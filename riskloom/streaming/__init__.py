"""Structured Streaming forms of the scoring and monitoring operators."""
