"""Structured Streaming forms of the bin builder."""
