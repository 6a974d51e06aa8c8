"""Tables that cut lineage, and bounded bit filters, in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter: 8 MB, whatever the size of the input. More keys only mean more false positives.
FILTER_BITS = 1 << 26


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a session on one machine that names none gets a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later steps read it and don't run what came before."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more, and let go of the shuffles that made them."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        released(frames[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Let go of the shuffles of jobs that are done: their files go when the driver's JVM collects what stands for them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bit_filter(frame: DataFrame, key: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value of a long column, by its remainder: ``bits`` / 8 bytes, built on the executors.

    For filters whose false positives do no harm; there are no false negatives.
    """
    # Spark counts both the buckets and the numbers in them from 1
    place = F.pmod(key, F.lit(bits)).cast("long") + 1
    rows = (
        frame.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
        .toArrow()
    )
    out = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in zip(rows["bucket"].to_pylist(), rows["bitmap"].to_pylist(), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bitmap, np.uint8)
    return out


def in_filter(filter_bytes: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Whether each key's bit is set. ``keys`` are the same longs, signed or not: ``bits`` is a power of two."""
    place = (keys.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    return (filter_bytes[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
