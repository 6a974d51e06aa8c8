"""Completions of a word prefix from the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.match import expand_prefix

SUGGEST_FIELDS = ("title", "content", "filename")


def suggestions(term_stats: DataFrame, prefix: str, n: int = 5) -> DataFrame:
    """(suggestion): the first n of the union of the first n terms of each field, sorted."""
    if not prefix.strip():
        return term_stats.select(F.col("term").alias("suggestion")).limit(0)
    terms = expand_prefix(term_stats.filter(F.col("field").isin(*SUGGEST_FIELDS)), prefix.lower())
    order = Window.partitionBy("field").orderBy("term")
    first = terms.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return first.select(F.col("term").alias("suggestion")).distinct().orderBy("suggestion").limit(n)
