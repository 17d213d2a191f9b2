"""Operators of a training-data pipeline: packing, near-duplicates, scoring, mixing, search."""
