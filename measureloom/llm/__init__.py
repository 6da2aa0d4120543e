"""Operators of a training-data pipeline: mixing, near-duplicates, filters, scans and scoring."""
