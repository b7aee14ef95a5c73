"""Training-data operators: search, deduplication, mixing, tokens, packing.

Nothing else in the library imports this subpackage.
"""
