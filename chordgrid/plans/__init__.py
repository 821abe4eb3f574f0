"""Whole pipelines and the queries made of them."""
