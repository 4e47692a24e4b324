"""Structured Streaming callers of the batch plans."""
