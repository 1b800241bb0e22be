"""Operators on frames of patches and pixels."""
