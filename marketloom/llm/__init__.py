"""Operators for preparing training text: filters, deduplication, packing, token files, formatting."""
