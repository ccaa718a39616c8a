"""Operators for preparing text corpora: deduplication, tokens, packing, sharding, search."""
