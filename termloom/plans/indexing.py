"""Files or tables to a stored index."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.extract import decode_text
from termloom.operators import ingest
from termloom.operators.index import FIELD_NAMES
from termloom.options import IngestOptions
from termloom.sources.files import list_mounted, read_mounted, scan_changed, scan_files, unreadable_files
from termloom.sources.store import VERSION, IndexStore
from termloom.sources.tables import as_corpus


#: the error of a file that the file source lists and does not deliver
UNREADABLE = "could not be read"


@dataclass(frozen=True)
class IngestRun:
    status: DataFrame  # path, status, reason, word_count, error
    report: DataFrame  # one row of counts
    duration_seconds: float
    batch: int | None


def wanted_files(files: DataFrame, options: IngestOptions) -> DataFrame:
    """Scan filters that look at names and sizes only, before any file is opened."""
    if options.ignore_hidden:
        files = ingest.not_hidden(files)
    files = ingest.not_excluded(files, options.exclude)
    files = ingest.supported(files, options.formats)
    return ingest.at_most(files, options.max_file_mb)


def file_documents(files: DataFrame, options: IngestOptions | None = None) -> DataFrame:
    """File rows with bytes -> document records."""
    options = options or IngestOptions()
    files = wanted_files(files, options)
    return as_corpus(files.withColumn("text", decode_text(F.col("raw"), options.encoding)).drop("raw", "filename", "extension"))


def index_documents(
    spark: SparkSession,
    path: str,
    index_dir: str,
    options: IngestOptions | None = None,
    mounted: bool = False,
    delete_missing: bool = False,
) -> IngestRun:
    """Index a file or a folder: only new and changed files are opened.

    ``mounted`` lists the folder by the tasks' own file system, with names the file source hides.
    ``delete_missing`` also removes documents whose files are gone.
    """
    options = options or IngestOptions()
    started = time.monotonic()
    store = IndexStore(spark, index_dir, buckets=options.buckets, stem=options.stem)
    if mounted:
        listed = list_mounted(spark, path, options.recursive)
    else:
        listed = scan_files(spark, path, options.recursive).drop("raw")
    known = store.doc_stats().select("path", "modified_time") if store.exists else None
    if mounted:
        todo = wanted_files(listed, options)
        todo = ingest.changed(todo, known) if known is not None else todo
        read = read_mounted(todo).filter("error IS NULL").drop("error")
    elif known is not None:
        read = scan_changed(spark, path, known, options.recursive)
    else:
        read = scan_files(spark, path, options.recursive)
    gone = None
    if delete_missing and known is not None:
        gone = known.join(listed.select("path"), "path", "left_anti")

    def errors(suspects: DataFrame) -> DataFrame:
        if mounted:
            return read_mounted(suspects).filter("error IS NOT NULL").select("path", "error")
        return unreadable_files(spark, path, suspects, options.recursive).withColumn("error", F.lit(UNREADABLE))

    outcome = partial(file_status, listed, errors, known, options)
    batch = store.ingest(file_documents(read, options), delete=gone, unique_paths=True, status=outcome)
    status = store.status(batch).drop("batch")
    return IngestRun(status, ingest.ingest_report(status), time.monotonic() - started, batch)


def file_status(
    listed: DataFrame,
    errors: Callable[[DataFrame], DataFrame],
    before: DataFrame | None,
    options: IngestOptions,
    stored: DataFrame,
) -> DataFrame:
    """Every listed file with its outcome. A wanted file that gave no document is blank, or ``errors`` tells why not."""
    wanted = wanted_files(listed, options)
    wanted = ingest.changed(wanted, before) if before is not None else wanted
    bad = errors(wanted.join(stored, "path", "left_anti"))
    done = stored.select("path", "word_count", F.lit("x").alias("content"))
    files = listed.join(done, "path", "left").join(bad, "path", "left")
    return ingest.ingest_status(files, options.exclude, options.formats, options.max_file_mb, before, options.ignore_hidden)


def index_table(
    documents: DataFrame, index_dir: str, buckets: int | None = None, stem: bool | None = None, unique_paths: bool = False
) -> int | None:
    """Index document records that come from tables."""
    store = IndexStore(documents.sparkSession, index_dir, buckets=buckets, stem=stem)
    return store.ingest(documents, unique_paths=unique_paths)


def reindex(
    spark: SparkSession,
    path: str,
    index_dir: str,
    options: IngestOptions | None = None,
    mounted: bool = False,
    delete_missing: bool = False,
) -> IngestRun:
    """Run indexing on the whole source again; unchanged files are still skipped."""
    return index_documents(spark, path, index_dir, options, mounted, delete_missing)


def index_stats(spark: SparkSession, index_dir: str) -> DataFrame:
    store = IndexStore(spark, index_dir)
    return ingest.index_stats(store.doc_stats(), FIELD_NAMES, index_dir, VERSION)
