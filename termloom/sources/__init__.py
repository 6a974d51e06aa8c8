"""Corpus sources and the stored index."""
