"""Training-data operators: deduplication, filtering, packing and archive formats.

Nothing outside this subpackage imports it, so it can be removed on its own.
"""
