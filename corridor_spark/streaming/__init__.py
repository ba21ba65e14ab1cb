"""Structured Streaming forms of the window queries."""
