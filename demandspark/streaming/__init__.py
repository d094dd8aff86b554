"""Structured Streaming jobs that reuse the batch column rules."""
