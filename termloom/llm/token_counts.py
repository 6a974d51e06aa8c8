"""Token counts from a cache keyed by digests of the normalised content and of the tokenizer's file.

Contents that the cache has are joined to their counts. The others are encoded once for each digest, and the
counts appended to the cache, where the next call finds them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("tokenizer", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Texts that the library encodes in one call.
AT_ONCE = 64
_LOADED: dict[str, object] = {}


def _load(path: str):
    """The tokenizer of a file, once in a worker: .json for tokenizers, .model for sentencepiece."""
    if path not in _LOADED:
        if path.endswith(".json"):
            # Spark has a task for each core; threads of the library's own would only wait for these
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[path] = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    return _LOADED[path]


def _count(batches: Iterator[pa.RecordBatch], path: str, version: str) -> Iterator[pa.RecordBatch]:
    count = _load(path)
    for batch in batches:
        counts: list[int] = []
        for at in range(0, len(batch), AT_ONCE):
            counts += count(batch.column("content").slice(at, AT_ONCE).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.array([version] * len(batch), pa.string()), pa.array(counts, pa.int64())],
            names=["digest", "tokenizer", "n_tokens"],
        )


def squeezed(text: Column) -> Column:
    """Runs of blanks, tabs and line ends as one blank: for tokenizers that read any white space as one.

    Tabs and line ends are replaced as plain strings; a pattern is only tried on texts that then hold two blanks in a row.
    """
    for mark in "\t\n\r":
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def cached(spark, cache: str) -> DataFrame:
    """The cache's rows; a folder that isn't there yet is an empty cache."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(cache)


def token_counts(
    documents: DataFrame, tokenizer: str, cache: str, text: str = "text", doc_id: str = "doc_id", normalise=None
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document, without special tokens at begin and end.

    ``tokenizer`` is a file that every executor has at this path, ``cache`` a shared folder. ``normalise`` maps
    the text to a content that the tokenizer counts alike; the default is the text itself. A null text is an
    empty one, with 0 bytes; null ids and repeated rows are kept; other columns are ignored; no documents give no
    rows. A digest that two calls append at the same time has two equal rows and counts once.
    """
    spark = documents.sparkSession
    version = hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()
    whole = F.coalesce(F.col(text), F.lit(""))
    content = normalise(whole) if normalise else whole
    digest = F.unhex(F.sha2(content, 256))
    known = cached(spark, cache).filter(F.col("tokenizer") == version)
    contents = documents.select(digest.alias("digest"), content.alias("content"))
    if not known.isEmpty():
        contents = contents.join(known, "digest", "left_anti")
    misses = contents.dropDuplicates(["digest"])
    counted = misses.mapInArrow(partial(_count, path=tokenizer, version=version), SCHEMA)
    counted.write.mode("append").parquet(cache)
    counts = cached(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), digest.alias("digest")
    )
    # every digest has its count by now; an inner join would make each digest twice, first to see that it isn't null
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
