"""Training-data operators: dedup, filtering, scanning, mixing, sharding and formatting.

Nothing else in the library imports this subpackage.
"""
