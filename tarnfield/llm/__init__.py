"""Operators for large text corpora: deduplication, filtering, scoring, sharding and packing."""
