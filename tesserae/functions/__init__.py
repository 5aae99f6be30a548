"""Scalar column expressions and driver-side helpers."""
