"""Structured Streaming forms of the batch summaries."""
