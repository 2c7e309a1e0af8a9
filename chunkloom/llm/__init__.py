"""Training-data operators: quality, mixing, counting, packing, deduplication, language, scoring and search.

Nothing outside this subpackage imports it.
"""
