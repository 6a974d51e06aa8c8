"""The log of executed searches: (query_id, query, ts, total_results, search_time, filters)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETAINED = 1000


def search_records(queries: DataFrame, results: DataFrame, search_time: float, filters: dict | None = None) -> DataFrame:
    """One record for each executed query, those without results too."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    pairs = [F.lit(str(part)) for pair in (filters or {}).items() for part in pair]
    applied = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return queries.join(counts, "query_id", "left").select(
        "query_id",
        "query",
        F.current_timestamp().alias("ts"),
        F.coalesce("total_results", F.lit(0)).cast("long").alias("total_results"),
        F.lit(float(search_time)).alias("search_time"),
        applied.alias("filters"),
    )


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def retain_last(log: DataFrame, n: int = RETAINED) -> DataFrame:
    """The n most recent records: a distributed top-n, not a window over the whole log."""
    return log.orderBy(F.desc("ts"), F.desc("query_id")).limit(n)


def search_stats(log: DataFrame) -> DataFrame:
    """One row of totals and means; no row for an empty log."""
    return log.agg(
        F.count(F.lit(1)).alias("total_searches"),
        F.avg("search_time").alias("average_search_time"),
        F.avg("total_results").alias("average_results_per_search"),
    ).filter("total_searches > 0")


def recent_queries(log: DataFrame, n: int = 10) -> DataFrame:
    """One row with the last n queries, the oldest of them first."""
    last = retain_last(log, n)
    ordered = F.array_sort(F.collect_list(F.struct("ts", "query_id", "query")))
    return last.agg(F.transform(ordered, lambda r: r["query"]).alias("recent_queries"))
