"""Structured Streaming forms of the resumable collection loops."""
