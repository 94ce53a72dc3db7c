"""Training-data operators: sharding, filters, near-duplicate search, packing, language models.

Nothing else in the library imports this subpackage.
"""
