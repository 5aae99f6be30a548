"""Operators of a training-data pipeline: dedup, search, decontamination, scoring, extraction, packing."""
