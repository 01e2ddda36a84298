"""Operators for preparing training data: deduplication, filtering, search and packing on Spark."""
