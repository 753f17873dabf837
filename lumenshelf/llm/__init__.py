"""Training-data operators: dedup, search, mixing, sharding, packing and text classifiers.

Nothing else in the library imports this subpackage.
"""
