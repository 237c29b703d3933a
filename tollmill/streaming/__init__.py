"""Structured Streaming forms of the hourly flow and audit operators."""
