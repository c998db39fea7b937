"""Structured Streaming twins of the picture operators."""
