"""Operators of a training-data pipeline: deduplication, extraction, scoring, tokens, packing.

Nothing outside this subpackage imports it.
"""
