"""Operators of a training-data pipeline: mixing, deduplication, filters, archives, tokens, search."""
