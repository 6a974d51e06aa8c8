"""Matching: which documents hold which query terms.

Query terms come as (query_id, field, term) rows, postings as (field, term, path, ...).
Hits are (query_id, path) rows. Boolean operators are set operations on hits.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import wildcard_to_regex
from termloom.operators.sizing import SMALL_ROWS, pinned_table, sized

HIT = ["query_id", "path"]
#: so many values at most are named to the scan of a stored table
NAMED = 1_000


def term_bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def query_terms(spark: SparkSession, queries: dict[int, list[str]], fields=("content",)) -> DataFrame:
    """Query terms from a Python literal, once for each field."""
    rows = [(qid, f, t) for qid, terms in queries.items() for t in terms for f in fields]
    return spark.createDataFrame(rows, "query_id long, field string, term string")


def in_fields(terms: DataFrame, fields) -> DataFrame:
    """(query_id, term) -> (query_id, field, term), once for each field."""
    return terms.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))


def lookup(
    postings: DataFrame, terms: DataFrame, buckets: int | None = None, small: bool | None = None
) -> DataFrame:
    """Postings of the given terms, with the columns of the term rows.

    Stored postings lie in one folder for each term bucket; the bucket is part of the join, so
    that the scan of a broadcast join prunes the folders no term falls into.
    """
    keys = ["field", "term"]
    if buckets is not None and "tbucket" in postings.columns:
        terms = terms.withColumn("tbucket", term_bucket(F.col("term"), buckets))
        keys.append("tbucket")
    return postings.join(sized(terms, small), keys)


def any_of(matched: DataFrame) -> DataFrame:
    """Documents that hold at least one term of the query, in any of its fields."""
    return matched.select(*HIT).distinct()


def all_of(matched: DataFrame, terms: DataFrame, small: bool | None = None) -> DataFrame:
    """Documents that hold every term of the query, each in one of its fields.

    The set collected for a (query, document) pair is bounded by the length of the query.
    """
    wanted = terms.groupBy("query_id").agg(F.size(F.collect_set("term")).alias("wanted"))
    held = matched.groupBy(*HIT).agg(F.size(F.collect_set("term")).alias("held"))
    return held.join(sized(wanted, small), "query_id").filter("held = wanted").select(*HIT)


def none_of(base: DataFrame, excluded: DataFrame) -> DataFrame:
    """Hits of ``base`` without those of ``excluded``; base may be plain (path) rows of a corpus."""
    keys = [c for c in HIT if c in base.columns]
    return base.join(excluded.select(*keys).distinct(), keys, "left_anti")


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, HIT, "left_semi")


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*HIT).unionByName(right.select(*HIT)).distinct()


def phrase_rows(spark: SparkSession, phrases: list[tuple[int, str]]) -> DataFrame:
    """(phrase_id, i, term, n_terms) of phrases whose words are parted by blanks."""
    rows = [(pid, i, w, len(p.split())) for pid, p in phrases for i, w in enumerate(p.split())]
    return spark.createDataFrame(rows, "phrase_id long, i int, term string, n_terms int")


def rarest_places(phrases: DataFrame, stats: DataFrame, small: bool | None = None) -> DataFrame:
    """(phrase_id, i, df) of the rarest term of each phrase; of equal ones, and of unknown ones, the first."""
    dfs = stats.groupBy("term").agg(F.sum("df").alias("df"))
    wanted = sized(phrases.select("term").distinct(), small)
    found = dfs.join(wanted, "term")
    counted = phrases.join(found, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = F.min(F.struct("df", "i")).alias("first")
    return counted.groupBy("phrase_id").agg(first).select("phrase_id", "first.i", "first.df")


def phrase_hits(
    postings: DataFrame, phrases: DataFrame, small: bool | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Places where the terms of a phrase stand in a row: (phrase_id, path, start).

    ``postings`` is (path, term, positions) of one field, ``phrases`` is (phrase_id, i, term, n_terms) with i from 0.
    A posting gives one row for each place of its term in a phrase: its positions, moved back by that place. The
    rows of a (phrase, document) meet, at most one for each word of the phrase, and the positions that all of them
    share are the starts; the shortest list is the first, and repeated words need no special case. With ``stats``
    (term, df) the documents are those of the rarest word of each phrase, so that the postings of frequent words are
    cut before they are moved.
    """
    moved = postings.join(sized(phrases, small), "term").select(
        "phrase_id", "path", "i", "n_terms", F.transform("positions", lambda p: p - F.col("i")).alias("starts")
    )
    if stats is not None:
        # looked up once: there is a row for each phrase
        rarest = rarest_places(phrases, stats, small)
        rarest, table = pinned_table(rarest, SMALL_ROWS)
        few = table is not None and sum(table["df"].to_pylist()) <= SMALL_ROWS
        led = moved.join(sized(rarest.drop("df"), table is not None), ["phrase_id", "i"], "left_semi").select("phrase_id", "path")
        moved = moved.join(F.broadcast(led) if few else led, ["phrase_id", "path"], "left_semi")
    lists = F.sort_array(F.collect_list(F.struct(F.size("starts").alias("size"), "i", "starts")))
    met = moved.groupBy("phrase_id", "path", "n_terms").agg(lists.alias("lists")).filter(F.size("lists") == F.col("n_terms"))
    shared = F.aggregate(
        F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0]["starts"], lambda found, one: F.array_intersect(found, one["starts"])
    )
    return met.select("phrase_id", "path", F.explode(shared).alias("start"))


# --- expansion over the vocabulary -------------------------------------------------------------

_GRAM = 3


def _literal_grams(patterns: DataFrame) -> DataFrame:
    """The piece of each pattern that a matching term must hold: the start of its longest literal.

    ``^`` and ``$`` stand for the two ends; neither can occur in a term.
    """
    anchored = F.concat(F.lit("^"), "pattern", F.lit("$"))
    literals = F.split(anchored, r"[*?]+")
    longest = F.array_sort(
        F.transform(literals, lambda s: F.struct((-F.length(s)).alias("size"), s.alias("literal")))
    )[0]["literal"]
    return patterns.withColumn("gram", longest.substr(1, _GRAM))


def expand_wildcards(
    vocabulary: DataFrame, patterns: DataFrame, small: bool | None = None
) -> DataFrame:
    """(pattern, term) pairs where the term matches a ``*`` / ``?`` pattern.

    Patterns are not compared with every term: both sides meet on a gram of up to three
    characters that the pattern prescribes, and only those pairs are verified.
    """
    terms = vocabulary.select("term").distinct()
    padded = F.concat(F.lit("^"), "term", F.lit("$"))

    def grams_of(size: int):
        places = F.sequence(F.lit(1), F.length(padded) - size + 1)
        return F.transform(places, lambda i: F.substring(padded, i, F.lit(size)))

    grams = F.array_distinct(F.flatten(F.array(*[grams_of(size) for size in range(1, _GRAM + 1)])))
    wanted = _literal_grams(patterns.select("pattern").distinct()).withColumn(
        "regex", wildcard_to_regex(F.col("pattern"))
    )
    pairs = terms.select("term", F.explode(grams).alias("gram")).join(sized(wanted, small), "gram")
    return pairs.filter(F.rlike("term", "regex")).select("pattern", "term")


def gram_rows(terms: DataFrame) -> DataFrame:
    """(term) -> (gram, term): every three characters in a row of ``^term$$``, once for each term."""
    padded = F.concat(F.lit("^"), "term", F.lit("$$"))
    grams = F.transform(F.sequence(F.lit(1), F.length("term") + 1), lambda i: F.substring(padded, i, F.lit(_GRAM)))
    return terms.select(F.explode(F.array_distinct(grams)).alias("gram"), "term")


def _named(rows: DataFrame, table: pa.Table | None, bucket: str, key: str) -> DataFrame:
    """Stored rows that may have one of the keys of a pinned table: other buckets, and sorted row groups, aren't read."""
    if table is None:
        return rows
    rows = rows.filter(F.col(bucket).isin(table[bucket].unique().to_pylist()))
    return rows.filter(F.col(key).isin(table[key].unique().to_pylist())) if table.num_rows <= NAMED else rows


def expand_stored_wildcards(grams: DataFrame, patterns: DataFrame, buckets: int) -> DataFrame:
    """:func:`expand_wildcards` over stored (gbucket, gram, term): only what a gram of the pattern leads to is read.

    A literal shorter than a gram is the beginning of the grams that a matching term has: the end is padded for that.
    """
    wanted = _literal_grams(patterns.select("pattern").distinct()).withColumn("regex", wildcard_to_regex(F.col("pattern")))
    # no gram begins with the end; a pattern that prescribes nothing else leads to all beginnings
    wanted = wanted.withColumn("gram", F.when(F.col("gram") == "$", F.lit("^")).otherwise(F.col("gram")))
    wanted, table = pinned_table(wanted.withColumn("gbucket", term_bucket(F.col("gram"), buckets)), SMALL_ROWS)
    sizes = {1, 2, _GRAM} if table is None else {len(g) for g in table["gram"].to_pylist()}
    found = [wanted.limit(0).select("pattern", F.col("pattern").alias("term"))]
    for size in sorted(sizes):
        own = wanted.filter(F.length("gram") == size)
        if size == _GRAM:
            full = table if table is None else table.filter(pc.equal(pc.utf8_length(table["gram"]), _GRAM))
            rows, keys = _named(grams, full, "gbucket", "gram"), ["gbucket", "gram"]
        else:
            rows, keys = grams.withColumn("begin", F.left("gram", F.lit(size))).drop("gram", "gbucket"), ["begin"]
            own = own.drop("gbucket").withColumnRenamed("gram", "begin")
        pairs = rows.join(sized(own, table is not None), keys)
        found.append(pairs.filter(F.rlike("term", "regex")).select("pattern", "term"))
    return union_all(found).distinct()


def expand_prefix(vocabulary: DataFrame, prefix: str) -> DataFrame:
    """Terms that begin with a prefix; the filter reaches the scan of stored term statistics."""
    return vocabulary.filter(F.col("term").startswith(prefix))


def _with_deletions(term):
    """The term and each text that is left when one character is taken out."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(term)),
        lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.length(term))),
    )
    return F.array_distinct(F.concat(F.array(term), cut))


def within_one_edit(a, b):
    """Distance 1: an insertion, a deletion, a substitution or a swap of two neighbours."""
    first = F.array_min(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))),
            lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)),
        )
    )
    swapped = F.concat(
        F.substring(a, F.lit(1), first - 1),
        F.substring(a, first + 1, F.lit(1)),
        F.substring(a, first, F.lit(1)),
        F.substring(a, first + 2, F.length(a)),
    )
    transposed = (F.length(a) == F.length(b)) & F.coalesce(swapped == b, F.lit(False))
    return (F.levenshtein(a, b, 1) >= 0) | transposed


def expand_fuzzy(
    vocabulary: DataFrame, words: DataFrame, prefix_length: int = 1, small: bool | None = None
) -> DataFrame:
    """(word, term) pairs at edit distance 0 or 1 that share the first ``prefix_length`` characters.

    Both sides are joined on their one-character deletions, which any two words at distance 1
    have in common; the pairs that meet are then verified. Nothing is compared with all terms.
    """
    terms = vocabulary.select("term").distinct()
    wanted = words.select("word").distinct().select(
        "word", F.explode(_with_deletions(F.col("word"))).alias("variant")
    )
    pairs = (
        terms.select("term", F.explode(_with_deletions(F.col("term"))).alias("variant"))
        .join(sized(wanted, small), "variant")
        .filter(F.left("term", F.lit(prefix_length)) == F.left("word", F.lit(prefix_length)))
        .filter(within_one_edit(F.col("word"), F.col("term")))
    )
    return pairs.select("word", "term").distinct()


def variant_rows(terms: DataFrame) -> DataFrame:
    """(term) -> (variant, first, length, term): the term and what is left of it without one character."""
    rows = terms.select(F.explode(_with_deletions(F.col("term"))).alias("variant"), "term")
    return rows.select("variant", F.left("term", F.lit(1)).alias("first"), F.length("term").alias("length"), "term")


def expand_stored_fuzzy(variants: DataFrame, words: DataFrame, buckets: int, prefix_length: int = 1) -> DataFrame:
    """:func:`expand_fuzzy` over stored (vbucket, variant, first, length, term).

    Only the buckets of the words' own variants are read, and of their rows those with a fitting first letter and length.
    """
    wanted = words.select("word").distinct().select(
        "word", F.explode(_with_deletions(F.col("word"))).alias("variant"), F.left("word", F.lit(1)).alias("word_first"),
        F.length("word").alias("word_length"),
    )
    wanted, table = pinned_table(wanted.withColumn("vbucket", term_bucket(F.col("variant"), buckets)), SMALL_ROWS)
    rows = _named(variants, table, "vbucket", "variant")
    pairs = rows.join(sized(wanted, table is not None), ["vbucket", "variant"]).filter(
        F.abs(F.col("length") - F.col("word_length")) <= 1
    )
    if prefix_length:
        pairs = pairs.filter(F.col("first") == F.col("word_first"))
        pairs = pairs.filter(F.left("term", F.lit(prefix_length)) == F.left("word", F.lit(prefix_length)))
    return pairs.filter(within_one_edit(F.col("word"), F.col("term"))).select("word", "term").distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
