"""Whole queries, and the catalogue of them."""
