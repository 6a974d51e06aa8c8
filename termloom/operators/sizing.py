"""Size checks that come before a broadcast or a change of parallelism."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side with at most this many short rows (terms, query ids, paths) may be broadcast.
SMALL_ROWS = 200_000
#: A query table with at most this many rows (of at most 500 characters each) is pinned.
SMALL_QUERIES = 20_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """True when the frame has at most ``rows`` rows; reads no more than that plus one."""
    return df.limit(rows + 1).count() <= rows


def pinned_table(df: DataFrame, rows: int) -> tuple[DataFrame, pa.Table | None]:
    """A table of at most ``rows`` rows as a literal of the plan, so that nothing above it runs twice.

    Also returns the rows themselves. Larger tables stay as they are. For query-side tables of short rows only.
    """
    table = df.limit(rows + 1).toArrow()
    if table.num_rows > rows:
        return df, None
    return df.sparkSession.createDataFrame(table, df.schema), table


def pin_if_small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    df, table = pinned_table(df, rows)
    return df, table is not None


def sized(df: DataFrame, small: bool | None = None) -> DataFrame:
    """Broadcast a frame of checked size; a larger one is left to a shuffled join under AQE.

    ``small`` is the outcome of an earlier check that also bounds this frame, for example that of
    the query table its rows come from; without one the frame itself is checked.
    """
    if small is None:
        small = is_small(df)
    return F.broadcast(df) if small else df


def spread_if_small(df: DataFrame) -> DataFrame:
    """Spread a table that lies in fewer splits than there are cores.

    One parquet row group is one task, however many cores wait. The shuffle is only added
    when the whole table is below one read split for each core, so it never grows with the data.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split_text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split_text)
    planned = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(planned)) < cores * split else df
