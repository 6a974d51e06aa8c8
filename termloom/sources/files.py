"""Files as rows: (path, filename, extension, size, modified_time, raw)."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import document
from termloom.operators.ingest import changed
from termloom.operators.sizing import is_small
from termloom.sources.scratch import shared_folder

#: up to this many changed files are named to the reader one by one
LISTED_FILES = 10_000
#: folders that a task lists where there are more folders than cores
FOLDERS_OF_A_TASK = 100

_FILE_SCHEMA = "path string, size long, modified_time timestamp, raw binary, error string"


def with_names(files: DataFrame) -> DataFrame:
    name = document.filename(F.col("path"))
    return files.withColumn("filename", name).withColumn("extension", document.extension(F.col("filename")))


def scan_files(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """A file or folder of any file system Spark can read. A missing path is an error.

    Columns that are not used are not read: without ``raw`` no file is opened, and a filter on
    ``size`` or ``modified_time`` leaves files out before they are opened. A file that vanishes or
    cannot be read gives no row (see ``unreadable_files``). The file source never lists empty files and
    names that begin with ``_`` or ``.``; on mounted folders ``list_mounted`` lists them all.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    files = reader.load(path).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_time"),
        F.col("content").alias("raw"),
    )
    return with_names(files)


def _escaped(paths: list[str]) -> list[str]:
    """Paths for the reader, which takes names as patterns."""
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]


def unreadable_files(spark: SparkSession, path: str, suspects: DataFrame, recursive: bool = True) -> DataFrame:
    """(path) of the suspects whose bytes the file source cannot deliver.

    Few suspects are named to the reader; many are found by a scan of the folder.
    """
    suspects = suspects.select("path")
    files = None
    if is_small(suspects, LISTED_FILES):
        paths = [row.path for row in suspects.collect()]  # at most LISTED_FILES
        if not paths:
            return suspects
        try:
            files = scan_files(spark, _escaped(paths), recursive=False)
        except AnalysisException:  # one of them is gone since it was listed
            files = None
    if files is None:
        files = scan_files(spark, path, recursive).join(suspects, "path", "left_semi")
    readable = files.filter(F.octet_length("raw") >= 0).select("path")
    return suspects.join(readable, "path", "left_anti")


_LISTED = "path string, size long, modified_time timestamp, folder boolean"


def _entries(folders: Iterator[pd.DataFrame], recursive: bool) -> Iterator[pd.DataFrame]:
    """What lies in each folder itself: files with their sizes and times, and folders to go on with."""
    for batch in folders:
        for folder in batch["path"]:
            with os.scandir(folder) as entries:
                while part := list(islice(entries, 10_000)):  # a folder of any size passes in parts
                    rows = []
                    for entry in part:
                        if entry.is_file():
                            stat = entry.stat()
                            rows.append((entry.path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), False))
                        elif recursive and entry.is_dir(follow_symlinks=False):
                            rows.append((entry.path, 0, None, True))
                    yield pd.DataFrame(rows, columns=["path", "size", "modified_time", "folder"])


def _files(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in paths:
        rows = []
        for path in batch["path"]:
            stat = os.stat(path)
            rows.append((path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), False))
        yield pd.DataFrame(rows, columns=["path", "size", "modified_time", "folder"])


def list_mounted(spark: SparkSession, root: str, recursive: bool = True, scratch: str | None = None) -> DataFrame:
    """(path, size, modified_time, filename, extension) of a folder every executor has mounted, with all names.

    Folders are listed level by level: the folders of a level are spread over all tasks, whatever folder they lie in,
    so no task walks a tree. Each level is stored in ``scratch``, a folder that all executors share (that of
    ``spark.checkpoint.dir`` if none is given), and no folder is listed twice, however often the result is used.
    """
    root = os.path.abspath(root)
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    here = f"{scratch or shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    start = spark.createDataFrame([(root,)], "path string")
    if os.path.isfile(root):
        start.mapInPandas(_files, _LISTED).write.parquet(f"{here}/level=0")
    else:
        cores, level, found = spark.sparkContext.defaultParallelism, 0, 1
        frontier = start
        while found:
            spread = frontier.repartition(min(found, max(cores, found // FOLDERS_OF_A_TASK)))
            spread.mapInPandas(lambda batches: _entries(batches, recursive), _LISTED).write.parquet(f"{here}/level={level}")
            frontier = spark.read.schema(_LISTED).parquet(f"{here}/level={level}").filter("folder").select("path")
            found, level = frontier.count(), level + 1
    listed = spark.read.schema(_LISTED + ", level int").parquet(here).filter("NOT folder")
    return with_names(listed.select("path", "size", "modified_time"))


def read_mounted(listed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Listed files with their bytes, one file in memory at a time; a failure is the ``error`` of its row only."""

    def reading(batches):
        for batch in batches:
            for path, size, modified in batch[["path", "size", "modified_time"]].itertuples(index=False):
                try:
                    with open(path, "rb") as file:
                        raw, error = file.read(), None
                except OSError as failure:
                    raw, error = None, failure.strerror or type(failure).__name__
                yield pd.DataFrame(
                    [(path, size, modified, raw, error)], columns=["path", "size", "modified_time", "raw", "error"]
                )

    cores = listed.sparkSession.sparkContext.defaultParallelism
    spread = listed.select("path", "size", "modified_time").repartition(partitions or cores, "path")
    return with_names(spread.mapInPandas(reading, _FILE_SCHEMA))


def scan_changed(spark: SparkSession, path: str, indexed: DataFrame, recursive: bool = True) -> DataFrame:
    """The files that are new or newer than their indexed state, without opening the others.

    Paths and times are compared first. When few files changed they are named to the reader;
    beyond the limit the whole folder is read and joined with the changed paths.
    """
    listed = scan_files(spark, path, recursive).drop("raw")
    todo = changed(listed, indexed).select("path")
    paths = [row.path for row in todo.limit(LISTED_FILES + 1).collect()]
    if not paths:
        return scan_files(spark, path, recursive).filter(F.lit(False))
    if len(paths) <= LISTED_FILES:
        try:
            return scan_files(spark, _escaped(paths), recursive=False)
        except AnalysisException:  # one of them is gone since it was listed
            pass
    return scan_files(spark, path, recursive).join(todo, "path", "left_semi")
