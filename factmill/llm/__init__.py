"""Operators of a training-data pipeline: scoring, decontamination, formatting, packing, deduplication.

Nothing outside this subpackage imports it.
"""
