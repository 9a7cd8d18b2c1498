"""Readers for files that Spark has no reader for."""
