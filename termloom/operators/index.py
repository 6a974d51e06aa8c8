"""The four tables retrieval works on, stored or derived from a corpus when they are used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import analysis

#: the index schema
FIELD_NAMES = (
    "content", "content_hash", "extension", "filename", "metadata", "modified_time", "path", "size",
    "tags", "title", "word_count",
)


@dataclass(frozen=True)
class Index:
    corpus: DataFrame
    postings: DataFrame  # path, field, term, tf, doc_len, positions
    term_stats: DataFrame  # field, term, df
    field_stats: DataFrame  # field, n_docs, avg_len
    buckets: int | None = None
    #: stored changes of term_stats, not added up; for lookups of single terms
    term_changes: DataFrame | None = None
    #: titles and contents are stemmed; searches stem their terms accordingly
    stem: bool = False
    #: of a stored index with replaced documents: all rows, and the (path, batch) of those that are replaced
    all_postings: DataFrame | None = None
    all_corpus: DataFrame | None = None
    removed: DataFrame | None = None
    #: of a stored index: what leads from the grams and the deletions of content terms to the terms
    grams: DataFrame | None = None
    variants: DataFrame | None = None
    #: of an index that is not stored: path, field and the words of the field
    tokens: DataFrame | None = None

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows of ``all_postings`` or ``all_corpus`` without those of replaced documents."""
        return rows if self.removed is None else rows.join(self.removed, ["path", "batch"], "left_anti")


def mean_lengths(field_stats: DataFrame) -> DataFrame:
    return field_stats.select("field", "n_docs", (F.col("total_len") / F.col("n_docs")).alias("avg_len"))


def index_of(
    corpus: DataFrame,
    stem: bool = False,
    fields: tuple[str, ...] = analysis.ALL_FIELDS,
    terms: tuple[str, ...] | None = None,
) -> Index:
    """An index that is not stored: every table is a plan over the corpus.

    When the query terms are known, ``terms`` keeps all others out of the inversion.
    """
    postings = analysis.analyze(corpus, stem, fields=fields, terms=terms)
    tokens = analysis.field_tokens(corpus, fields=fields)
    return Index(
        corpus=corpus,
        postings=postings,
        term_stats=analysis.term_stats(postings),
        field_stats=mean_lengths(analysis.field_stats(tokens)),
        stem=stem,
        tokens=tokens if terms is None else None,
    )
