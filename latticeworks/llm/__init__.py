"""Training-data operators: search, scans, scoring, filtering, dedup, mixing, packing, sharding, fixity.

Nothing outside this subpackage imports it.
"""
