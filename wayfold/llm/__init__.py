"""Operators of a training-data pipeline: filters, formatting, duplicates, mixing, packing."""
