"""Whole jobs: indexing and batch search."""
