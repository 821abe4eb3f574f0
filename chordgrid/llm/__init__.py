"""Operators for training-data corpora: media, toxicity, packing, joins, sharding, deduplication, tokens, mixing, licences."""
