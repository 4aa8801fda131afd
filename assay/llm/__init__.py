"""Operators for large training corpora: deduplication, filtering, mixing and sharding."""
