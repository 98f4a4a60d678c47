"""Training-data operators: HTML extraction, packing, dedup, BPE, license, quality, joins, secrets.

Nothing else in the library imports this subpackage.  Every module holds one
operator with its own general interface; ``queries`` registers them.
"""
