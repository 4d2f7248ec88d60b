"""Structured Streaming over the log."""
