"""Operators for preparing training data: search, filtering, deduplication and packing."""
