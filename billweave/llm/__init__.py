"""Operators for training data at scale: search, duplicates, archives, contamination, packing, scoring and sharding."""
