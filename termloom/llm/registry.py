"""One query for each operator over the given tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe
from termloom.llm.decontaminate import contaminated
from termloom.llm.language import identify_held_out
from termloom.llm.line_dedup import LineStore
from termloom.llm.ngram_join import near_duplicates
from termloom.llm.order_minhash import edited_fingerprints
from termloom.llm.repeats import remove_repeats
from termloom.llm.scratch import shared_folder
from termloom.llm.secrets import digest_columns, secrets
from termloom.llm.sharding import shard
from termloom.llm.spelling import damaged_words, variants
from termloom.llm.suffix_tree import score_held_out
from termloom.llm.token_counts import squeezed, token_counts
from termloom.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return digest_columns(secrets(documents(spark, folder)))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_held_out(documents(spark, folder))


@query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(documents(spark, folder), 40).select(
        "*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    # a cache of its own, so that the query encodes every distinct text
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    counts = token_counts(
        documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), cache, normalise=squeezed
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json")))


@query
def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(documents(spark, folder))


@query
def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_held_out(documents(spark, folder))


@query
def op10_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).drop("kept")


@query
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # a store of its own, so that the query inserts all documents
    store = LineStore(spark, f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}")
    store.insert(documents(spark, folder))
    return store.clean(documents(spark, folder), texts=False)


ORACLES["op11_line_dedup"] = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM split
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT keyed.*, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants(damaged_words(documents(spark, folder)))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
