"""Operators for large text corpora: deduplication, mixing, packing, filtering and counting."""
