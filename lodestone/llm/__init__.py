"""Training-data operators: sharding, dedup, WARC, decontamination, mixing, scoring.

Nothing else in the library imports this subpackage.
"""
