"""Full-text indexing and batch retrieval over Spark DataFrames."""

from termloom.options import IngestOptions, RenderOptions, SearchOptions

__all__ = ["IngestOptions", "RenderOptions", "SearchOptions"]
