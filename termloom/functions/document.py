"""Document attributes as columns."""

from __future__ import annotations

from mimetypes import MimeTypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import WORD_OR_MARK, strip


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory part of a path; ``.`` when there is none."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def extension(name: Column) -> Column:
    """Lower-cased last suffix with its dot; empty for none and for a bare dot file."""
    return F.regexp_extract(F.lower(name), r"^.+(\.[^./]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^./]+$", "$1")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def word_count(content: Column) -> Column:
    """Words and punctuation marks, each counted as one token."""
    return F.size(F.regexp_extract_all(content, F.lit(WORD_OR_MARK), F.lit(0))).cast("long")


def title(content: Column, name: Column) -> Column:
    """The first line when it reads like a title, else the file name without its suffix."""
    first = strip(F.regexp_extract(content, r"(?U)^\s*([^\n]*)", 1))
    good = F.length(first).between(1, 99) & ~first.endswith(".")
    return F.when(good, first).otherwise(stem(name))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n")).cast("long")


def char_count(content: Column) -> Column:
    return F.length(content).cast("long")


def paragraph_count(content: Column) -> Column:
    pieces = F.split(content, "\n\n")
    return F.size(F.filter(pieces, lambda piece: piece.rlike(r"(?U)\S"))).cast("long")


def mime_table(spark: SparkSession) -> DataFrame:
    """(extension, mime_type) of the standard library's built-in table, without system files."""
    known = MimeTypes(filenames=()).types_map[True]
    return spark.createDataFrame(sorted(known.items()), "extension string, mime_type string")


def mime_type(suffix: Column) -> Column:
    """The same table as a literal of the plan: no join stands between a corpus and its columns."""
    known = MimeTypes(filenames=()).types_map[True]
    text = "\n".join(f"{ext}\t{kind}" for ext, kind in sorted(known.items()))
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\n"), F.lit("\t")), suffix)


def metadata(content: Column, suffix: Column, mime_type: Column) -> Column:
    """Metadata record; file sources give neither creation nor access times, so they are null."""
    return F.struct(
        suffix.alias("file_type"),
        F.lit(None).cast("string").alias("created_time"),
        F.lit(None).cast("string").alias("accessed_time"),
        line_count(content).alias("line_count"),
        char_count(content).alias("char_count"),
        paragraph_count(content).alias("paragraph_count"),
        mime_type.alias("mime_type"),
    )
