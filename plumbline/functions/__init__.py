"""Scalar functions as Columns and SQL text."""
