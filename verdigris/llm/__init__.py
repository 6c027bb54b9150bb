"""Operators for preparing training text: sharding, duplicates, classifiers, packing, privacy."""
