"""Entity tags from a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import words
from termloom.functions.wordlists import TAG_LABELS
from termloom.operators.analysis import content_tokens
from termloom.operators.sizing import sized


def entity_ngrams(entities: DataFrame, labels: tuple[str, ...] = TAG_LABELS) -> DataFrame:
    """(text, label) -> (entity, ngram, n) of the entities with a wanted label: the n words of each, as one text."""
    named = entities.filter(F.col("label").isin(*labels)).select(F.col("text").alias("entity")).distinct()
    named = named.withColumn("entity_words", words(F.col("entity")))
    return named.select("entity", F.array_join("entity_words", " ").alias("ngram"), F.size("entity_words").alias("n")).filter("n > 0")


def tag_documents(
    corpus: DataFrame, entities: DataFrame, labels: tuple[str, ...] = TAG_LABELS, max_chars: int | None = None
) -> DataFrame:
    """(path, tags): the entities found in each document, sorted; documents without any are absent.

    The distinct word n-grams of a document, of the lengths that the dictionary has, meet the dictionary in one join
    on the whole n-gram. Whole texts are read; ``max_chars`` looks at the beginning only.
    """
    if max_chars is not None:
        corpus = corpus.withColumn("content", F.left("content", F.lit(max_chars)))
    dictionary = entity_ngrams(entities, labels)
    lengths = sorted(row["n"] for row in dictionary.select("n").distinct().collect())  # a row for each length
    if not lengths:
        return corpus.select("path", F.array().cast("array<string>").alias("tags")).filter("false")

    def ngrams(n: int):
        if n == 1:
            return F.col("tokens")
        begins = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - (n - 1)))
        return F.coalesce(
            F.transform(begins, lambda i: F.array_join(F.slice("tokens", i, F.lit(n)), " ")), F.array().cast("array<string>")
        )

    found = F.array_distinct(F.concat(*[ngrams(n) for n in lengths]))
    held = content_tokens(corpus).select("path", F.explode(found).alias("ngram"))
    tagged = held.join(sized(dictionary.select("ngram", "entity")), "ngram")
    return tagged.groupBy("path").agg(F.array_sort(F.collect_set("entity")).alias("tags"))
