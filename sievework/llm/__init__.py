"""Operators for preparing training text: quality, secrets, near copies, packing, archives, toxicity, token files."""
