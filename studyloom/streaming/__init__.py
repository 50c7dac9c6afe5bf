"""Structured Streaming jobs over the attempt log."""
