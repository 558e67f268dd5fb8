"""Training-data operators: near-duplicates, packing, extraction, search, scoring and filtering.

Nothing else in the library imports this subpackage.
"""
