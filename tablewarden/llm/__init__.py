"""Operators for preparing training text: language, packing, privacy, duplicates, filters, mixing, counts and search."""
