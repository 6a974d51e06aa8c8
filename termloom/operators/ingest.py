"""Scan filters, incremental selection, upsert and the ingest report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import is_blank, matches_any

#: Reasons in the order in which they apply.
SKIP_REASONS = ("hidden", "excluded", "unsupported", "up_to_date", "too_large", "empty")


def not_hidden(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("filename").startswith("."))


def is_excluded(exclude: tuple[str, ...]) -> Column:
    """A pattern leaves a file out when it fits the whole name or the whole path."""
    return matches_any(F.col("filename"), exclude) | matches_any(F.col("path"), exclude)


def not_excluded(files: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    return files.filter(~is_excluded(exclude))


def supported(files: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    return files.filter(F.col("extension").isin(*formats))


def at_most(files: DataFrame, max_file_mb: float) -> DataFrame:
    """A file of exactly the cap is kept; the filter reaches the file source."""
    return files.filter(F.col("size") <= int(max_file_mb * 1024 * 1024))


def not_empty(documents: DataFrame) -> DataFrame:
    return documents.filter(~is_blank(F.col("content")))


def changed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that are not indexed or newer than their indexed state.

    Only paths and times of the index take part, so its side of the join stays narrow.
    """
    known = indexed.select("path", F.col("modified_time").alias("indexed_time"))
    return (
        files.join(known, "path", "left")
        .filter(F.col("indexed_time").isNull() | (F.col("modified_time") > F.col("indexed_time")))
        .drop("indexed_time")
    )


def newest(documents: DataFrame, key: str = "path", by: str = "modified_time", tie: str = "content_hash") -> DataFrame:
    """One whole row for each key: the newest, rows without a time last, equal times by ``tie`` where there is one."""
    order = [F.col(by).desc_nulls_last(), *([F.col(tie)] if tie in documents.columns else [])]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return documents.withColumn("_place", place).filter("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """All of ``new`` and the rows of ``old`` whose key it does not hold."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def ingest_status(
    files: DataFrame,
    exclude: tuple[str, ...],
    formats: tuple[str, ...],
    max_file_mb: float,
    indexed: DataFrame | None = None,
    ignore_hidden: bool = True,
) -> DataFrame:
    """(path, status, reason, word_count, error): what becomes of each scanned file.

    A file that could not be read says why in ``error``, which its row carries from the read to the report.
    """
    if indexed is not None:
        known = indexed.select("path", F.col("modified_time").alias("indexed_time"))
        files = files.join(known, "path", "left")
    else:
        files = files.withColumn("indexed_time", F.lit(None).cast("timestamp"))
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    reason = (
        F.when(F.col("filename").startswith(".") & F.lit(ignore_hidden), "hidden")
        .when(is_excluded(exclude), "excluded")
        .when(~F.col("extension").isin(*formats), "unsupported")
        .when(F.col("modified_time") <= F.col("indexed_time"), "up_to_date")
        .when(F.col("size") > int(max_file_mb * 1024 * 1024), "too_large")
        .when(error.isNotNull(), "unreadable")
        .when(is_blank(F.col("content")), "empty")
    )
    status = (
        F.when(F.col("reason") == "unreadable", "error").when(F.col("reason").isNotNull(), "skipped").otherwise("indexed")
    )
    word_count = F.when(F.col("status") == "indexed", F.col("word_count"))
    return (
        files.withColumn("reason", reason)
        .withColumn("status", status)
        .select(
            "path", "status", "reason", word_count.alias("word_count"),
            F.when(F.col("status") == "error", error).alias("error"),
        )
    )


def ingest_report(status: DataFrame) -> DataFrame:
    """One row: total, indexed, skipped and failed files."""
    return status.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "indexed").alias("indexed_files"),
        F.count_if(F.col("status") == "skipped").alias("skipped_files"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def index_stats(corpus: DataFrame, field_names: tuple[str, ...], location: str, version: str) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("document_count")).select(
        "document_count",
        F.lit(",".join(field_names)).alias("field_names"),
        F.lit(location).alias("index_path"),
        F.lit(version).alias("schema_version"),
    )
