"""Incremental ingest of a landing folder into a stored index."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.options import IngestOptions
from termloom.plans.indexing import UNREADABLE, file_documents, file_status
from termloom.sources.files import with_names
from termloom.sources.store import IndexStore

_BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(
    spark: SparkSession,
    landing: str,
    index_dir: str,
    checkpoint: str,
    options: IngestOptions | None = None,
    max_files: int | None = None,
    recursive: bool = True,
) -> StreamingQuery:
    """Index what lands in a folder, then stop: run it again for the next files.

    The file source remembers the files it has seen. Each micro-batch is one index batch: documents
    are replaced by path, the newest of a batch wins. The epoch is committed with the batch and with what became of
    its files (``IndexStore.status``), so a repeated epoch changes nothing. There is no state, so there is no
    watermark either.
    """
    options = options or IngestOptions()
    reader = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILES)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(landing).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_time"),
        F.col("content").alias("raw"),
    )

    def store_batch(batch: DataFrame, epoch: int) -> None:
        store = IndexStore(batch.sparkSession, index_dir, buckets=options.buckets, stem=options.stem)
        files = with_names(batch)

        def errors(suspects: DataFrame) -> DataFrame:
            read = batch.filter(F.octet_length("raw") >= 0).select("path")
            return suspects.select("path").join(read, "path", "left_anti").withColumn("error", F.lit(UNREADABLE))

        outcome = partial(file_status, files.drop("raw"), errors, None, options)
        store.ingest(file_documents(files, options), epoch=(checkpoint, epoch), status=outcome)

    return (
        files.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
