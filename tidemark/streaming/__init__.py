"""Structured Streaming queries over change logs."""
