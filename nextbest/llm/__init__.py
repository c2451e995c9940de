"""Training-data operators: token counts, deduplication, packing, filters, sharding.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` registers the thin ``opN_*``
queries over the given tables.
"""
