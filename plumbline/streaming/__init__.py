"""Structured Streaming forms (an extension; the model itself has no clock)."""
