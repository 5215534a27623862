"""Structured Streaming over the same transforms."""
