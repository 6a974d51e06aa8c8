"""A pipeline that makes training data of the documents table.

Documents in no known language go; of documents that are near copies of each other one stays; documents that hold
a benchmark item go; credentials are redacted; the rest is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, language
from termloom.llm.decontaminate import decontaminate
from termloom.llm.ngram_join import distinct_documents
from termloom.llm.scratch import stored
from termloom.llm.secrets import redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show."""
    return language.accepted(docs.select(*COLUMNS), language.train(docs))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return distinct_documents(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials redacted and their characters counted anew."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with the digests of the ids and of what they decode to."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source", "n_chars"))
    return encoded.select(
        "doc_id", "lang", "source", "n_chars", "n_tokens", "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe_encoding),
]
#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
