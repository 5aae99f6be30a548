"""Structured Streaming forms of the read preparation."""
