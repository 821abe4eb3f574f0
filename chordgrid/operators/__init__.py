"""Operators on DataFrames keyed by ``imgid``."""
