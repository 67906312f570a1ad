"""Training-data operators: deduplication, filtering, packing, search and archives.

Nothing else in the library imports this subpackage.  ``registry`` holds the
thin contract queries and their SQL oracles.
"""
