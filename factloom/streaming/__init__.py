"""Structured Streaming jobs over the same rules as the batch operators."""
