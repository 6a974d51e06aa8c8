"""Document tables as a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import document
from termloom.functions.extract import extract_text
from termloom.functions.text import is_blank

CORPUS_COLUMNS = (
    "path", "filename", "extension", "size", "modified_time", "content", "content_hash", "title",
    "word_count", "language", "tags", "metadata",
)


def documents_as_files(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) -> file rows with text; the table has no times, so they are made up
    from the id: one minute for each."""
    return documents.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("modified_time"),
        F.col("text"),
        F.col("lang").alias("language"),
        F.array("lang", "source").alias("tags"),
    )


def pages_as_files(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> file rows with text; an address gets the suffix of its format."""
    return pages.select(
        F.concat(F.col("url"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.octet_length("html").cast("long").alias("size"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("modified_time"),
        F.col("html").alias("text"),
        F.lit("en").alias("language"),
        F.array().cast("array<string>").alias("tags"),
    )


def conversations_as_files(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> file rows with text, one for each turn."""
    return conversations.select(
        F.format_string("conversations/%d/%d.txt", "conv_id", "turn").alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("modified_time"),
        F.col("text"),
        F.lit("en").alias("language"),
        F.array("role").alias("tags"),
    )


def as_corpus(files: DataFrame, markup: bool = True) -> DataFrame:
    """File rows with text -> the full document record; blank documents are dropped.

    ``markup=False`` says that no row is HTML or Markdown, so the extraction is not even planned.
    Every attribute is an expression over its own row: what a query does not use is not computed.
    """
    for name, default in (("language", F.lit("en")), ("tags", F.array().cast("array<string>"))):
        if name not in files.columns:
            files = files.withColumn(name, default)
    named = files.withColumn("filename", document.filename(F.col("path"))).withColumn(
        "extension", document.extension(F.col("filename"))
    )
    text = extract_text(F.col("extension"), F.col("text")) if markup else F.col("text")
    extracted = named.withColumn("content", text).filter(~is_blank(F.col("content")))
    content = F.col("content")
    return extracted.select(
        "path",
        "filename",
        "extension",
        "size",
        "modified_time",
        "content",
        document.content_hash(content).alias("content_hash"),
        document.title(content, F.col("filename")).alias("title"),
        document.word_count(content).alias("word_count"),
        "language",
        "tags",
        document.metadata(content, F.col("extension"), document.mime_type(F.col("extension"))).alias("metadata"),
    )
