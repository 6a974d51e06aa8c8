"""Text analysis: tokens, postings and term statistics.

Every token of a document and field sits in one row, so a document is inverted inside its
row: sort the words with their positions, find where a word begins, cut the runs. This needs
no shuffle and no aggregation, where exploding tokens and grouping them again would move
every posting once more across the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.porter import porter_stem
from termloom.functions.text import words

ALL_FIELDS = ("title", "content", "filename", "tags")
STEMMED_FIELDS = ("title", "content")


def stem_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """(term) -> (term, stem) over distinct words."""
    return vocabulary.select("term").distinct().withColumn("stem", porter_stem("term"))


def field_tokens(
    corpus: DataFrame, carry: tuple[str, ...] = (), fields: tuple[str, ...] = ALL_FIELDS
) -> DataFrame:
    """One row for each document and field with its token array.

    Text fields are split into words; tags are kept whole, as they are written.
    """
    empty = F.array().cast("array<string>")
    arrays = [
        F.struct(
            F.lit(name).alias("field"),
            F.coalesce(F.col("tags") if name == "tags" else words(F.col(name)), empty).alias("tokens"),
        )
        for name in fields
    ]
    return corpus.select("path", *carry, F.inline(F.array(*arrays)))


def content_tokens(corpus: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Token arrays of the content field only; the other columns are never read."""
    return corpus.select(
        "path", *carry, F.lit("content").alias("field"), words(F.col("content")).alias("tokens")
    )


def explode_tokens(token_arrays: DataFrame) -> DataFrame:
    """(path, field, pos, term): one row for each token, positions from 0."""
    return token_arrays.select("path", "field", F.posexplode("tokens").alias("pos", "term"))


def doc_stats(token_arrays: DataFrame) -> DataFrame:
    return token_arrays.select("path", "field", F.size("tokens").cast("long").alias("doc_len"))


def invert(
    token_arrays: DataFrame, carry: tuple[str, ...] = (), terms: tuple[str, ...] | None = None
) -> DataFrame:
    """Postings (path, field, doc_len, term, tf, positions), one row for each document and term.

    With ``terms`` only these are inverted; lengths and positions stay those of the whole text.
    """
    pairs = F.transform("tokens", lambda term, pos: F.struct(term.alias("term"), pos.alias("pos")))
    if terms is not None:
        pairs = F.filter(pairs, lambda pair: pair["term"].isin(*terms))
    # no filter on the size of the run: it would be pushed down and sort every document twice
    ordered = token_arrays.select(
        "path", "field", *carry, F.size("tokens").cast("long").alias("doc_len"), F.sort_array(pairs).alias("run")
    ).withColumn("n", F.size("run"))
    begins = ordered.withColumn(
        "begin",
        F.filter(
            F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))),
            lambda i: (i == 1) | (F.element_at("run", i)["term"] != F.element_at("run", i - 1)["term"]),
        ),
    )

    def posting(first, j):
        last = F.coalesce(F.get("begin", j + 1), F.col("n") + 1) - 1
        positions = F.transform(F.sequence(first, last), lambda k: F.element_at("run", k)["pos"])
        return F.struct(F.element_at("run", first)["term"].alias("term"), positions.alias("positions"))

    postings = begins.select(
        "path", "field", *carry, "doc_len", F.inline(F.transform("begin", posting))
    )
    return postings.withColumn("tf", F.size("positions").cast("long"))


def countable(tokens: Column, field: Column) -> Column:
    """The tokens; as in :func:`invert`, tags with a null among them hold no term."""
    broken = (field == "tags") & (F.size(F.array_compact(tokens)) < F.size(tokens))
    return F.when(~broken, tokens).otherwise(F.array().cast("array<string>"))


def _counted(token_arrays: DataFrame) -> tuple[DataFrame, Column]:
    """Rows (path, field, doc_len) and their distinct terms with frequencies."""
    tokens = countable(F.col("tokens"), F.col("field"))
    ordered = token_arrays.select(
        "path", "field", F.size("tokens").cast("long").alias("doc_len"), F.sort_array(tokens).alias("run")
    ).withColumn("n", F.size("run"))
    begin = F.filter(
        F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))),
        lambda i: (i == 1) | (F.element_at("run", i) != F.element_at("run", i - 1)),
    )

    def entry(first, j):
        tf = F.coalesce(F.get("begin", j + 1), F.col("n") + 1) - first
        return F.struct(F.element_at("run", first).alias("term"), tf.cast("long").alias("tf"))

    return ordered.withColumn("begin", begin), F.transform("begin", entry)


def count_terms(token_arrays: DataFrame) -> DataFrame:
    """(path, field, doc_len, counted): one row for each row of tokens with its distinct terms and their frequencies.

    These are the postings of :func:`invert` without their positions, kept together.
    """
    rows, counted = _counted(token_arrays)
    return rows.select("path", "field", "doc_len", counted.alias("counted"))


def counted_postings(token_arrays: DataFrame) -> DataFrame:
    """(path, field, doc_len, term, tf): the same, a row for each term."""
    rows, counted = _counted(token_arrays)
    # no name for the array: a filter on its size would be pushed down and sort every document again
    return rows.select("path", "field", "doc_len", F.inline(counted))


def merge_stems(postings: DataFrame) -> DataFrame:
    """Postings of words by their stem, with one row for each stem of a document.

    Rows that are dealt by path stay where they are.
    """
    keep = [c for c in postings.columns if c not in ("term", "tf", "positions")]
    # a group is one stem of one document: bounded by the document, whatever the corpus size
    return postings.groupBy(*keep, "term").agg(
        F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    )


def analyze(
    corpus: DataFrame,
    stem: bool = False,
    carry: tuple[str, ...] = (),
    fields: tuple[str, ...] = ALL_FIELDS,
    terms: tuple[str, ...] | None = None,
) -> DataFrame:
    """Postings of the fields with the stemming or the standard analyzer."""
    if not stem:
        return invert(field_tokens(corpus, carry, fields), carry, terms)
    # texts are dealt by path, which are far shorter than postings: words with one stem then meet in the task of their document
    dealt = corpus.select("path", *carry, *fields).repartition("path")
    postings = invert(field_tokens(dealt, carry, fields), carry)
    stem_of = F.when(F.col("field").isin(*STEMMED_FIELDS), porter_stem("term")).otherwise(F.col("term"))
    return merge_stems(postings.withColumn("term", stem_of))


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df, cf): partial counts come before the shuffle, so a hot term is a few rows."""
    return postings.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def token_stats(corpus: DataFrame) -> DataFrame:
    """:func:`term_stats` of the postings of :func:`analyze` without stems, without making them for words.

    No word is sorted and no position kept: each counts for cf, and each distinct word of a row, which follow them,
    for df. Tags, which may be null and are few, are inverted.
    """
    every = F.posexplode(F.concat("tokens", F.array_distinct("tokens"))).alias("at", "term")
    words_of = field_tokens(corpus, fields=tuple(name for name in ALL_FIELDS if name != "tags"))
    rows = words_of.select("field", F.size("tokens").alias("n"), every)
    distinct = F.col("at") >= F.col("n")
    counted = rows.groupBy("field", "term").agg(F.count_if(distinct).alias("df"), F.count_if(~distinct).alias("cf"))
    return counted.unionByName(term_stats(analyze(corpus, fields=("tags",))))


def field_stats(token_arrays: DataFrame) -> DataFrame:
    """(field, n_docs, total_len) over all documents, those with an empty field too."""
    return token_arrays.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("tokens")).alias("total_len")
    )


def drop_short_and_long(terms: DataFrame, low: int = 3, high: int = 50) -> DataFrame:
    return terms.filter(F.length("term").between(low, high))


def drop_stop_words(terms: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    return terms.filter(~F.col("term").isin(*stop_words))


def starts_with_word(terms: DataFrame) -> DataFrame:
    return terms.filter(F.col("term").rlike(r"^[\p{L}\p{N}_]"))
