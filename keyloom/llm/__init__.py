"""Operators of a training-data pipeline: quality, dedup, filtering, mixing, packing and formatting.

Nothing outside this subpackage imports it.
"""
