"""Operators for preparing training text: sharding, filters, near duplicates, mixing, packing, scoring."""
