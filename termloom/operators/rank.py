"""Scores, top-k, filters, sorting and the result record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.match import term_bucket
from termloom.operators.sizing import sized

#: Scores are rounded, so that copies of a document tie and a rank does not depend on sum order.
SCORE_DIGITS = 9
K1 = 1.2
B = 0.75

RESULT_COLUMNS = (
    "query_id", "rank", "score", "path", "filename", "title", "extension", "size",
    "modified_time", "word_count", "tags", "metadata",
)


def path_bucket(path, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def weigh_terms(
    terms: DataFrame,
    term_stats: DataFrame,
    field_stats: DataFrame,
    small: bool | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Query terms with df, number of documents and mean field length.

    The statistics join the few query terms and not the many hits. ``term_stats`` may hold several
    changes of one term: those of the query terms alone are added up. Stored statistics lie in term
    buckets, which the join prunes. Terms no document holds drop out.
    """
    keys = ["field", "term"]
    if buckets is not None and "tbucket" in term_stats.columns:
        terms = terms.withColumn("tbucket", term_bucket(F.col("term"), buckets))
        keys.append("tbucket")
    found = term_stats.join(sized(terms, small), keys)
    totals = found.groupBy("query_id", "field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    return totals.join(F.broadcast(field_stats), "field")  # one row for each of the four fields


def term_score(scorer: str = "bm25"):
    """Score of one matched (field, term) from tf, doc_len, df, n_docs and avg_len."""
    tf, df, n = F.col("tf"), F.col("df"), F.col("n_docs")
    if scorer == "bm25":
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return tf * (F.log(n / (df + 1)) + 1)


def score_hits(matched: DataFrame, scorer: str = "bm25", keep_terms: bool = False) -> DataFrame:
    """(query_id, path, score): the sum over the matched terms and fields of a document.

    ``keep_terms`` adds ``matched``, the set of those terms: bounded by the terms of the query, or by the words of the
    document where a pattern stands for many.
    """
    score = F.round(F.sum(term_score(scorer)), SCORE_DIGITS).alias("score")
    terms = [F.collect_set("term").alias("matched")] if keep_terms else []
    return matched.groupBy("query_id", "path").agg(score, *terms)


def top_k(scored: DataFrame, k: int = 20) -> DataFrame:
    """The best k documents of each query with rank from 1, ties by path.

    The planner keeps k rows of a query in each task before the shuffle (WindowGroupLimit), so a
    query that matches a third of the corpus sends k rows a task and not all its hits.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_single(scored: DataFrame, k: int = 20) -> DataFrame:
    """top_k for the hits of one query: a distributed top-k without any window."""
    best = scored.orderBy(F.desc("score"), "path").limit(k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return best.withColumn("rank", F.row_number().over(order))


def at_least(results: DataFrame, min_score: float = 0.1) -> DataFrame:
    return results.filter(F.col("score") >= min_score)


def filter_attributes(results: DataFrame, file_types=None, max_size=None, modified_after=None) -> DataFrame:
    """Keep documents of the given types, of at most a size, changed at or after a time."""
    if file_types is not None:
        results = results.filter(F.col("extension").isin(*file_types))
    if max_size is not None:
        results = results.filter(F.col("size") <= max_size)
    if modified_after is not None:
        results = results.filter(F.col("modified_time") >= F.lit(modified_after).cast("timestamp"))
    return results


def sort_results(results: DataFrame, sort_by: str = "relevance", descending: bool = True) -> DataFrame:
    """Give the results of each query new ranks; the old rank breaks ties in both directions."""
    keys = {
        "relevance": F.col("score"),
        "filename": F.lower("filename"),
        "size": F.col("size"),
        "modified_time": F.col("modified_time"),
        "word_count": F.col("word_count"),
    }
    order = [F.col("rank").asc()]
    if sort_by in keys:
        order.insert(0, keys[sort_by].desc() if descending else keys[sort_by].asc())
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def attach_attributes(
    ranked: DataFrame, corpus: DataFrame, buckets: int | None = None, small: bool | None = None
) -> DataFrame:
    """Results with the attributes of their documents; missing attributes get defaults.

    The ranked side has at most k rows for each query: it is broadcast when its size is checked,
    and prunes the path buckets of a stored corpus.
    """
    keys = ["path"]
    if buckets is not None and "pbucket" in corpus.columns:
        ranked = ranked.withColumn("pbucket", path_bucket(F.col("path"), buckets))
        keys.append("pbucket")
    found = corpus.join(sized(ranked, small), keys)
    defaults = {
        "filename": F.lit(""), "title": F.lit(""), "extension": F.lit(""),
        "size": F.lit(0).cast("long"), "word_count": F.lit(0).cast("long"),
        "tags": F.array().cast("array<string>"),
    }
    for name, default in defaults.items():
        found = found.withColumn(name, F.coalesce(name, default))
    return found
