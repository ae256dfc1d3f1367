"""Operators for preparing training corpora: deduplication, filtering, mixing, search and sharding.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns a
DataFrame; ``entries`` registers one query for each.
"""
