"""Sharding by a minimax contiguous partition of ordered atomic groups.

Documents with equal texts are one group; a group lies in one of ``UNITS`` ordered units by a hash of its text,
so a unit is atomic too, and there are so many units whatever the number of documents. The smallest capacity
with which ``shards`` runs of units hold everything is found by binary search, each step a greedy check; the
units are then cut into runs within that capacity, each as near to the mean of what is left as it allows.

Only sums by unit meet in one task. Everything is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.scratch import stored

#: Ordered units: a fixed number, some hundred for each shard.
UNITS = 1 << 14
#: Parts of each shard that are numbered side by side.
CELLS = 1 << 10
#: Bytes that a document takes besides its text.
OVERHEAD = 16

# runs that a greedy pass opens with this capacity
_NEEDED = """aggregate(units, named_struct('n', 1, 'load', 0L), (g, u) ->
    if(g.load + u.size > {cap}, named_struct('n', g.n + 1, 'load', u.size), named_struct('n', g.n, 'load', g.load + u.size)),
    g -> g.n)"""

_CAPACITY = f"""aggregate(sequence(1, 62), named_struct('low', low, 'high', high), (s, i) ->
    if(s.low >= s.high, s, if({_NEEDED.format(cap="((s.low + s.high) div 2)")} <= {{shards}},
        named_struct('low', s.low, 'high', (s.low + s.high) div 2),
        named_struct('low', (s.low + s.high) div 2 + 1, 'high', s.high))),
    s -> s.low)"""

# greedy from the end: element j - 1 is the first unit from which j runs hold all that follows
_LATEST = """aggregate(reverse(units), named_struct('load', 0L, 'starts', cast(array() AS array<int>)), (b, u) ->
    if(b.load + u.size > capacity,
        named_struct('load', u.size, 'starts', concat(b.starts, array(u.place + 1))),
        named_struct('load', b.load + u.size, 'starts', b.starts)),
    b -> b.starts)"""

_CUTS = """aggregate(units, named_struct('shard', 0, 'load', 0L, 'left', high, 'target', high / {shards}, 'cuts', cast(array() AS array<int>)),
    (s, u) -> if(s.load > 0 AND (s.load + u.size > capacity OR
            (s.shard < {shards} - 1 AND s.load + u.size / 2 > s.target AND u.place >= coalesce(get(latest, {shards} - s.shard - 2), 0))),
        named_struct('shard', s.shard + 1, 'load', u.size, 'left', s.left - u.size,
            'target', s.left / greatest({shards} - s.shard - 1, 1), 'cuts', concat(s.cuts, array(u.unit))),
        named_struct('shard', s.shard, 'load', s.load + u.size, 'left', s.left - u.size, 'target', s.target, 'cuts', s.cuts)),
    s -> s.cuts)"""


def partition(units: DataFrame, shards: int) -> DataFrame:
    """(unit, size) -> one row (capacity, cuts): the smallest capacity and the unit that begins each run after the first.

    For a bounded number of units: they are searched as one array.
    """
    ordered = units.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("unit", "size"))),
            lambda u, i: F.struct(i.alias("place"), u["unit"].alias("unit"), u["size"].alias("size")),
        ).alias("units"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("high"),
        F.greatest(F.coalesce(F.max("size"), F.lit(0)), F.ceil(F.coalesce(F.sum("size"), F.lit(0)) / shards)).alias("low"),
    )
    return (
        ordered.withColumn("capacity", F.expr(_CAPACITY.format(shards=shards)))
        .withColumn("latest", F.expr(_LATEST))
        .withColumn("cuts", F.expr(_CUTS.format(shards=shards)))
        .select("capacity", "cuts")
    )


def shard(documents: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every document in one of ``shards`` shards, equal texts together.

    ``size`` is the UTF-8 bytes of the text and ``OVERHEAD``; ``slot`` counts the documents of a shard from 0
    without gaps. A null text is an empty one; null ids are kept; repeated rows are documents of their own. Where
    one group is larger than the mean, its size is the capacity. Fewer groups than shards leave shards empty.
    Other columns are ignored; no documents give no rows.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    # short rows, stored so that the texts are read once
    short = documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content).cast("long") + OVERHEAD).alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.pmod(F.xxhash64(content), F.lit(UNITS)).cast("int").alias("unit"),
        F.pmod(F.xxhash64(F.col(doc_id), content), F.lit(CELLS)).cast("int").alias("cell"),
    )
    rows = stored(short, "sizes")
    cuts = partition(rows.groupBy("unit").agg(F.sum("size").alias("size")), shards).first()["cuts"]
    number = F.size(F.filter(F.lit(cuts).cast("array<int>"), lambda c: c <= F.col("unit")))
    # documents are numbered within cells of a shard, so that no shard is one task and copies are spread
    placed = rows.withColumn("shard", number.cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id")) - 1
    # at most shards x CELLS short rows
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(cells), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))
    )
