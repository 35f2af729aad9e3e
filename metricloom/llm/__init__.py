"""Operators for preparing training data: archives, tokens, filtering, deduplication, packing."""
