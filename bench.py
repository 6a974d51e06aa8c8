"""Headline timings: index build, batch search on the stored index, and single operators.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. Every query runs twice; the better run counts, the first one is listed as cold.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from check_oracles import session
from termloom import SearchOptions
from termloom.plans.indexing import index_table
from termloom.plans.registry import MAX_QUERY, QUERIES, batch_queries, documents_corpus, mixed_queries, table
from termloom.plans.search import batch_search
from termloom.sources.store import IndexStore

OPERATORS = (
    "flagship_search", "html_text", "markdown_text", "term_statistics", "phrase_match", "wildcard_expansion",
    "fuzzy_expansion", "entity_tags", "ingest_report_counts", "suggestions", "log_statistics",
)


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    # the shared folder of a cluster, else a folder of this machine
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    stamp = f"{base}/bench-{os.getpid()}"
    built: list[str] = []

    def build() -> None:
        built.append(f"{stamp}-{len(built)}")
        index_table(documents_corpus(spark, folder), built[-1], buckets=8, unique_paths=True)

    def stored():
        return IndexStore(spark, built[-1]).index()

    exact = SearchOptions(fuzzy=False, max_query_length=MAX_QUERY)
    # the texts of the first six words of each item: as many queries as in earlier rounds
    few_mixed = mixed_queries(spark, folder).filter("query_id % 600000 < 6")
    jobs = {
        "index_build": build,
        "batch_search": lambda: run(batch_search(stored(), batch_queries(spark, folder), exact)),
        "batch_search_all_kinds": lambda: run(batch_search(stored(), few_mixed)),
        "single_search": lambda: run(batch_search(stored(), batch_queries(spark, folder).limit(1), exact)),
    }
    for name in OPERATORS:
        jobs[name] = lambda name=name: run(QUERIES[name](spark, folder))

    cold, best = {}, {}
    for name, job in jobs.items():
        times = []
        for _ in range(2):
            started = time.monotonic()
            job()
            times.append(round(time.monotonic() - started, 3))
        cold[name], best[name] = times[0], min(times)

    documents = table(spark, folder, "documents").count()
    n_queries = batch_queries(spark, folder).count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "cold": cold,
                "documents": documents,
                "docs_per_sec": round(documents / best["index_build"], 1),
                "batch_queries": n_queries,
                "queries_per_sec": round(n_queries / best["batch_search"], 1),
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
