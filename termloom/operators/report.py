"""Reports over result records; a group is the results of one query, at most its limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.document import parent
from termloom.functions.render import CLOSINGS, header, item

JSON_FIELDS = (
    "title", "filename", "path", "score", "rank", "content_snippet", "extension", "size",
    "word_count", "modified_time", "tags", "highlights", "metadata",
)


def file_type_counts(results: DataFrame) -> DataFrame:
    """(query_id, file_type, n, score_sum, first_rank)"""
    file_type = F.coalesce(F.nullif(F.col("extension"), F.lit("")), F.lit("unknown"))
    return results.groupBy("query_id", file_type.alias("file_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"), F.min("rank").alias("first_rank")
    )


def result_stats(results: DataFrame) -> DataFrame:
    """(query_id, total_results, average_score, file_types map); queries without results are absent."""
    entries = F.sort_array(F.collect_list(F.struct("file_type", "n")))
    return file_type_counts(results).groupBy("query_id").agg(
        F.sum("n").alias("total_results"),
        F.round(F.sum("score_sum") / F.sum("n"), 3).alias("average_score"),
        F.map_from_entries(entries).alias("file_types"),
    )


def summary_lines(queries: DataFrame, results: DataFrame, search_time: float = 0.0) -> DataFrame:
    """(query_id, summary) with the three most frequent file types, the first seen first among equals."""
    counts = file_type_counts(results)
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "first_rank")
    placed = counts.withColumn("place", F.row_number().over(order))
    shown = F.concat_ws(" ", F.col("n").cast("string"), F.col("file_type"))
    top = F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", shown.alias("shown")))))
    lines = placed.groupBy("query_id").agg(F.sum("n").alias("n"), top["shown"].alias("types"))
    time = F.format_string("%.2f", F.lit(float(search_time)))
    some = F.concat(
        F.lit("Found "), F.col("n").cast("string"), F.lit(" documents for '"), F.col("query"), F.lit("' in "), time,
        F.lit("s. Top file types: "), F.array_join("types", ", "),
    )
    none = F.concat(F.lit("No results found for '"), F.col("query"), F.lit("' in "), time, F.lit("s"))
    return queries.join(lines, "query_id", "left").select(
        "query_id", F.when(F.col("n").isNull(), none).otherwise(some).alias("summary")
    )


def related_directories(results: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, directories): the first n distinct parent folders of the results of a query."""
    folders = F.array_sort(F.collect_set(parent(F.col("path"))))
    return results.groupBy("query_id").agg(
        F.transform(F.slice(folders, 1, n), lambda d: F.concat(F.lit("Explore more files in: "), d)).alias("directories")
    )


def render(queries: DataFrame, results: DataFrame, style: str = "markdown", details: bool = True) -> DataFrame:
    """(query_id, response): header and results in rank order for each query, those without any too."""
    if style == "json":
        return render_json(queries, results)
    items = results.select("query_id", F.struct("rank", item(style, details).alias("text")).alias("item"))
    lists = items.groupBy("query_id").agg(F.sort_array(F.collect_list("item"))["text"].alias("texts"))
    count = F.when(F.col("texts").isNull(), 0).otherwise(F.size("texts"))
    lines = F.concat(F.array(header(style, F.col("query"), count)), F.coalesce("texts", F.array().cast("array<string>")))
    response = F.concat(F.array_join(lines, "\n"), F.lit(CLOSINGS[style]))
    return queries.join(lists, "query_id", "left").select("query_id", response.alias("response"))


def json_record():
    """The struct of one result with a rounded score and an ISO time."""
    special = {
        "score": F.round("score", 3),
        "modified_time": F.date_format("modified_time", "yyyy-MM-dd'T'HH:mm:ss"),
    }
    return F.struct(*[special.get(name, F.col(name)).alias(name) for name in JSON_FIELDS])


def render_json(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, response): one JSON text for each query, never cut."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "record")))["record"]
    lists = (
        results.select("query_id", "rank", json_record().alias("record"))
        .groupBy("query_id")
        .agg(ordered.alias("results"))
    )
    found = F.coalesce("results", F.array().cast(lists.schema["results"].dataType))
    answer = F.struct("query", F.size(found).alias("total_results"), found.alias("results"))
    return queries.join(lists, "query_id", "left").select(
        "query_id", F.to_json(answer).alias("response")
    )


def export_json(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.select("query_id", json_record().alias("result")).select("query_id", "result.*").write.json(path)


def json_lines(results: DataFrame) -> DataFrame:
    return results.select("query_id", "rank", F.to_json(json_record()).alias("json"))
