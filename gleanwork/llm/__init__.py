"""Training-data operators: duplicates, mixing, quality, personal data, packing, token counts.

Nothing outside this subpackage imports it.
"""
