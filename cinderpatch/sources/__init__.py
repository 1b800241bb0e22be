"""Readers: schema sidecars and record files."""
