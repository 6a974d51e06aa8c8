"""The folder for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a session on one machine that names none gets a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there, so that what uses them twice makes them once."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)
