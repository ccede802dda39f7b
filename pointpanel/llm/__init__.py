"""Operators of a training-data pipeline: quality, toxicity, deduplication, search, packing, mixing and archive derivatives."""
