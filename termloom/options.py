"""Options passed to the plans; every field is a plain argument, nothing is read from a file."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from termloom.functions.wordlists import CUSTOM_STOP_WORDS, DEFAULT_EXCLUDES, DEFAULT_FORMATS

SEARCH_FIELDS = ("title", "content", "filename", "tags")


@dataclass(frozen=True)
class IngestOptions:
    recursive: bool = True
    ignore_hidden: bool = True
    exclude: tuple[str, ...] = DEFAULT_EXCLUDES
    formats: tuple[str, ...] = DEFAULT_FORMATS
    max_file_mb: int = 50
    encoding: str = "utf-8"
    stem: bool | None = None  # that of a stored index, False for a new one
    #: number of hash buckets of the stored corpus and postings, fixed when an index is created;
    #: aim at about 1 GB of stored data for each bucket
    buckets: int | None = None  # those of a stored index, 16 for a new one


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 20
    min_score: float = 0.1
    scorer: str = "bm25"  # or "tfidf"
    fields: tuple[str, ...] = SEARCH_FIELDS
    fuzzy: bool = True
    fuzzy_prefix: int = 1
    stem: bool = False
    remove_stop_words: bool = True
    custom_stop_words: tuple[str, ...] = CUSTOM_STOP_WORDS
    min_word_length: int = 3
    max_word_length: int = 50
    max_query_length: int = 500
    file_types: tuple[str, ...] | None = None
    max_size: int | None = None
    modified_after: datetime | str | None = None
    filter_stage: str = "after_topk"  # or "before_topk"
    sort_by: str = "relevance"
    descending: bool = True
    highlight: bool = True
    snippet_length: int = 200


@dataclass(frozen=True)
class RenderOptions:
    format: str = "markdown"  # plain, html or json
    include_details: bool = True
