"""Registered queries: the operators applied to the driver tables."""
