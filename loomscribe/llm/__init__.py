"""Training-data operators: token counts, deduplication, packing, quality and search.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
