"""Order MinHash fingerprints of texts, and of texts edited with what follows them in an order.

A k-mer is ``K`` bytes of the UTF-8 text, numbered by how often it stood before. The hashes of all numbered
k-mers fall into ``BINS`` bins; the ``TUPLE`` smallest of each bin are taken in the order of the text, and their
k-mers hashed to one entry. A bin with one k-mer, as in short texts, takes the smallest of the next bin that has any
as well, so that every entry tells an order. So an entry is kept only where the same k-mers are chosen and stand in the same
order, which makes the likeness fall with the edit distance and not with the shared content alone. Bins split
one hash instead of hashing every k-mer again for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import mix

K = 8
BINS = 128
TUPLE = 2
_BITS = 7
_U = np.uint64
_FACTORS = mix(np.arange(301, 301 + TUPLE + 1, dtype=_U)) | _U(1)
#: K-mers of each bin that are sorted in a long text; a bin that has too few of them makes it sort all.
_CANDIDATES = 10


def fingerprint(text: str) -> np.ndarray:
    """``BINS`` entries of 16 bits; 0 is an empty bin. An empty text has empty bins only."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(BINS, np.uint16)
    if not raw:
        return out
    # a text of less than K bytes is one k-mer
    padded = np.frombuffer(raw.ljust(K, b"\0"), np.uint8)
    n = len(padded) - K + 1
    kmers = mix(np.ndarray((n,), "<u8", padded, strides=(1,)).copy())
    numbered = kmers.copy()
    ranked = np.sort(kmers)
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(again):
        slot = np.minimum(np.searchsorted(again, kmers), len(again) - 1)
        places = np.flatnonzero(again[slot] == kmers)
        places = places[np.argsort(kmers[places], kind="stable")]
        first = np.flatnonzero(np.diff(kmers[places], prepend=kmers[places[:1]] ^ _U(1)))
        number = np.arange(len(places)) - np.repeat(first, np.diff(first, append=len(places)))
        numbered[places] = mix(kmers[places] + number.astype(_U) * _FACTORS[0])
    bins = (numbered >> _U(64 - _BITS)).astype(np.int64)
    counts = np.bincount(bins, minlength=BINS)
    some = np.arange(n)
    if n > 4 * BINS * _CANDIDATES:
        bound = _U(int((1 << 64) * (BINS * _CANDIDATES / n)) & ((1 << 64) - 1))
        small = np.flatnonzero((numbered << _U(_BITS)) < bound)
        if (np.bincount(bins[small], minlength=BINS) >= np.minimum(counts, TUPLE)).all():
            some = small
    some = some[np.argsort(numbered[some])]
    begin = np.searchsorted(bins[some], np.arange(BINS))
    full = np.flatnonzero(counts > 0)
    chosen = np.full((len(full), TUPLE), n, np.int64)
    for j in range(TUPLE):
        has = counts[full] > j
        chosen[has, j] = some[begin[full[has]] + j]
    if len(full) > 1:
        # the next bin with a k-mer, the first one after the last
        short = np.flatnonzero(counts[full] < TUPLE)
        chosen[short, 1] = some[begin[full[(short + 1) % len(full)]]]
    chosen.sort(axis=1)
    total = np.full(len(full), _FACTORS[0])
    for j in range(TUPLE):
        has = chosen[:, j] < n
        total[has] += kmers[chosen[has, j]] * _FACTORS[j + 1]
    out[full] = np.maximum(mix(total) & _U(0xFFFF), _U(1)).astype(np.uint16)
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Share of equal entries among the bins that either has; two empty texts are alike."""
    either = int(((one > 0) | (two > 0)).sum())
    return float(((one == two) & (one > 0)).sum() / either) if either else 1.0


def shown(entries: np.ndarray) -> str:
    return entries.astype(">u2").tobytes().hex()


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order, the first of the next part last -> a row for each but that one."""
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    last: tuple[int | None, str, np.ndarray] | None = None
    over = False
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))
        for doc_id, text, ahead in zip(*columns, strict=True):
            # of rows that lead the next part, equal ones, the first will do
            if over or (ahead and last is None):
                continue
            own = fingerprint(text)
            if last is not None:
                before, old, old_print = last
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                edited_print = fingerprint(edited)
                rows.append(
                    (
                        before, len(old), hashlib.sha256(edited.encode("utf-8")).hexdigest(), shown(old_print),
                        shown(edited_print), likeness(old_print, edited_print), likeness(old_print, own),
                    )
                )
            last, over = (doc_id, text, own), bool(ahead)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


# cuts above an id, by halving the sorted cuts
_ABOVE = """aggregate(sequence(0, {steps}), named_struct('low', 0, 'high', {n}), (s, i) -> if(s.low >= s.high, s,
    if(element_at({cuts}, cast((s.low + s.high) div 2 + 1 AS int)) > doc_id,
        named_struct('low', s.low, 'high', cast((s.low + s.high) div 2 AS int)),
        named_struct('low', cast((s.low + s.high) div 2 + 1 AS int), 'high', s.high))), s -> {n} - s.low)"""


def _part(cuts: list[int], nameless: int) -> Column:
    """The number of cuts above an id: the highest ids are part 0. Rows without one are the last parts, by their hash."""
    array = f"array({', '.join(f'{c}L' for c in cuts)})"
    above = F.expr(_ABOVE.format(steps=len(cuts).bit_length(), n=len(cuts), cuts=array)) if cuts else F.lit(0)
    by_hash = F.shiftright((F.shiftright("hash", 32) + (1 << 31)) * nameless, 32)
    return F.when(F.col("doc_id").isNull(), len(cuts) + 1 + by_hash).otherwise(above).cast("int").alias("part")


def edited_fingerprints(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of the text edited with the next document's, ids descending.

    The last half of the code points is replaced by as many from the start of the next text, or by all of it.
    After the last document comes the first. Null texts are empty ones; null ids come last; equal ids are ordered
    by a hash of the text; repeated rows follow each other. Other columns are ignored; no documents give no rows.

    Documents go to parts by ranges of their ids, those without one by ranges of the hash, and the first of each part
    to the part before it as well, so each part has all it needs. A part is sorted and read through, an Arrow batch of
    texts at a time.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = F.coalesce(F.col(text), F.lit(""))
    ids = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("hash"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = ids.agg(
        F.percentile_approx("doc_id", shares, 10 * parts).alias("cuts"), F.count("*").alias("n"), F.count("doc_id").alias("named")
    ).first()
    cuts = sorted(set(found["cuts"] or [])) if parts > 1 else []
    nameless = max(1, -(-(found["n"] - found["named"]) * parts // max(found["n"], 1)))
    part = _part(cuts, nameless)
    # ids descending as longs ascending
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down")
    firsts = (
        ids.select(part, down, "hash").groupBy("part").agg(F.min(F.struct("down", "hash")).alias("first")).orderBy("part").collect()
    )  # a short row for each part
    leads = spark.createDataFrame(
        [(row["part"], row["first"]["down"], row["first"]["hash"], firsts[k - 1]["part"]) for k, row in enumerate(firsts)],
        "part int, down long, hash long, leads int",
    )
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), content.alias("text"), F.xxhash64(content).alias("hash")
    ).select("doc_id", "text", "hash", part, down)
    to = F.array(F.struct(F.col("part"), F.lit(False).alias("ahead")), F.struct(F.col("leads").alias("part"), F.lit(True).alias("ahead")))
    sent = rows.join(F.broadcast(leads), ["part", "down", "hash"], "left").withColumn(
        "to", F.explode(F.filter(to, lambda t: t["part"].isNotNull()))
    )
    return (
        sent.select("doc_id", "text", "hash", "down", F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"))
        .repartitionById(len(cuts) + 1 + nameless, F.col("part"))
        .sortWithinPartitions("ahead", "down", "hash")
        .select("doc_id", "text", "ahead")
        .mapInArrow(_neighbours, _SCHEMA)
    )
