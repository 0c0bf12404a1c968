"""Operators of a training-data pipeline: near-duplicates, scores, packing, encoding, extraction."""
