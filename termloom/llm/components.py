"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label) of every linked node; label is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label of the label, so the
    rounds grow with the logarithm of a chain's length. Rounds end in stored tables. Nulls link nothing.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = stored(links.union(links.select("b", "a")).distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jumps = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        after = stored(
            lower.join(jumps, "low").select("node", F.least("low", "jump").alias("label"), F.col("label").alias("old")),
            "labels",
        )
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
