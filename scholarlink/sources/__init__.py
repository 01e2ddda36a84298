"""Readers and flatteners of snapshot tables."""
