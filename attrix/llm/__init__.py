"""Operators of a training-data pipeline: deduplication, quality, privacy, toxicity, tokens and packing.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
