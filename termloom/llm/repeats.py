"""Removal of long byte strings that occur more than once, by refining the intervals of sampled suffixes.

Two suffixes that share ``LENGTH`` bytes share every shorter prefix, so the intervals of equal suffixes can be
refined step by step over the suffixes of all shards together, and a suffix alone in its interval drops out:

1. Every window of ``LENGTH`` bytes is filed under its anchor, the string of ``ANCHOR`` bytes in it with the
   smallest hash. Equal windows have equal anchors at equal offsets. Anchors that occur once end here.
2. The windows of an anchor are taken in cells of neighbouring starts. All windows of a cell share its core.
   Cells whose cores occur once end here; cells that are equal as a whole are repeated as a whole.
3. Only cells that are neither are compared window by window.

Intervals are counted by hashes of their strings, with partial sums in every task: no string, however frequent,
is gathered anywhere. Texts move only for step 3 and for the removal, and only those that a bounded bit filter
lets through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.scratch import bit_filter, in_filter, stored
from termloom.llm.words import mix, slices

LENGTH = 400
ANCHOR = 64
#: Starts of windows in a cell.
CELL = 42
#: Starts that are worked on at once in a long text.
PIECE = 1 << 18
#: Rows that a task holds before it hands them on.
HELD = 100_000

_U = np.uint64
_PLACES = _U((1 << 20) - 1)
_BYTES = mix(np.arange(1001, 1257, dtype=_U))
_BASE = 0x9E3779B97F4A7C15 | 5
_C = mix(np.arange(2001, 2004, dtype=_U)) | _U(1)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    n = PIECE + 2 * LENGTH
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[_U(1)], np.full(n, b, _U)])) for b in (_BASE, inverse))


class _Prefix:
    """Hashes of any strings of one piece, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[data] * _powers()[0][: len(data)])])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _powers()[1][starts])


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, first byte, bytes): every window of a text lies in one piece and starts in one only."""
    for first, last, data, offsets in slices(texts):
        for row in range(first, last):
            begin, end = offsets[row - first], offsets[row - first + 1]
            for at in range(0, end - begin - LENGTH + 1, PIECE):
                yield row, at, data[begin + at : min(begin + at + PIECE + LENGTH - 1, end)]


def _anchors(data: np.ndarray) -> tuple[_Prefix, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, and of each run of windows under one anchor: the anchor's hash and place, first and last start."""
    prefix = _Prefix(data)
    n = len(data) - ANCHOR + 1
    raw = (prefix.sums[ANCHOR:] - prefix.sums[:n]) * _powers()[1][:n]
    # the smallest hash, and of equal ones the first
    least = (mix(raw) & ~_PLACES) | np.arange(n, dtype=_U)
    width, span = LENGTH - ANCHOR + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    windows = len(data) - LENGTH + 1
    least = np.minimum(least[:windows], least[width - span : width - span + windows])
    place = (least & _PLACES).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], windows) - 1
    place = place[first]
    return prefix, mix(raw[place] ^ _C[0]), place, first, last


def _column(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    return pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind))


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([*found, np.zeros(0, _U)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["anchor", "n"])

    for batch in batches:
        found, held = [], 0
        for _, _, data in _pieces(batch.column("text")):
            found.append(_anchors(data)[1])
            held += len(found[-1])
            if held > HELD:
                yield counted(found)
                found, held = [], 0
        yield counted(found)


def _cells(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """(row, core, whole, first, last) of the cells of anchors in the filter; first and last are starts in the text."""
    def columns(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column(c) for c in out], names=["row", "core", "whole", "first", "last"])

    for batch in batches:
        rows = batch.column("row").to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        held = 0
        for row, at, data in _pieces(batch.column("text")):
            prefix, anchors, place, first, last = _anchors(data)
            some = np.flatnonzero(in_filter(wanted.value, anchors))
            if len(some) == 0:
                continue
            place, first, last = place[some], first[some], last[some]
            # cells by offset of the anchor in the window
            low, high = (place - last) // CELL, (place - first) // CELL
            count = high - low + 1
            of = np.repeat(np.arange(len(some)), count)
            q = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
            latest = place[of] - CELL * q
            s, e = np.maximum(first[of], latest - CELL + 1), np.minimum(last[of], latest)
            core = prefix(latest, latest - CELL + 1 + LENGTH) + q.astype(_U) * _C[1]
            shape = ((s - latest + CELL) * CELL + (e - s)).astype(_U)
            whole = prefix(s, e + LENGTH) + shape * _C[2] + q.astype(_U) * _C[1]
            for part, values in zip(out, (np.full(len(of), rows[row]), mix(core).view(np.int64), mix(whole).view(np.int64), at + s, at + e), strict=True):
                part.append(values)
            held += len(of)
            if held > HELD:
                yield columns(out)
                out, held = [[], [], [], [], []], 0
        yield columns(out)


def _ranges(lists: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the structs in one list, as numbers: there may be one for each byte of a text."""
    begin, end = lists.offsets[k].as_py(), lists.offsets[k + 1].as_py()
    if not lists[k].is_valid:
        end = begin
    part = lists.values.slice(begin, end - begin)
    return part.field("first").to_numpy(), part.field("last").to_numpy()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with cells -> (row, start, window) for every window of the cells."""
    for batch in batches:
        rows, texts = batch.column("row").to_pylist(), batch.column("text")
        for k in range(len(rows)):
            out: list[list[np.ndarray]] = [[], [], []]
            firsts, lasts = _ranges(batch.column("cells"), k)
            for _, at, data in _pieces(texts.slice(k, 1)):
                prefix = _Prefix(data)
                for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
                    if at <= first and last + LENGTH <= at + len(data):
                        starts = np.arange(first, last + 1)
                        for part, values in zip(out, (np.full(len(starts), rows[k]), starts, prefix(starts - at, starts - at + LENGTH).view(np.int64)), strict=True):
                            part.append(values)
            yield pa.RecordBatch.from_arrays([_column(c) for c in out], names=["row", "start", "window"])


def _picked(batches: Iterator[pa.RecordBatch], wanted, inside: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose key is in the filter, or those whose isn't."""
    for batch in batches:
        keep = in_filter(wanted.value, batch.column("row").to_numpy()) == inside
        yield batch.filter(pa.array(keep))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> the removed bytes and the text that remains."""
    for batch in batches:
        ids, texts, spans = batch.column("doc_id"), batch.column("text"), batch.column("spans")
        for first, last, data, offsets in slices(texts):
            rows = []
            for k in range(last - first):
                raw = data[offsets[k] : offsets[k + 1]]
                edges = np.zeros(len(raw) + 1, np.int32)
                firsts, lasts = _ranges(spans, first + k)
                np.add.at(edges, firsts, 1)
                np.add.at(edges, lasts + LENGTH, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = raw[~gone].tobytes()
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), *columns],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(row, text) -> (row, first, last): runs of starts of windows that occur more than once."""
    spark = texts.sparkSession
    anchors = texts.select("text").mapInArrow(_anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    wanted = spark.sparkContext.broadcast(bit_filter(anchors.filter("n > 1"), F.col("anchor")))
    cells = stored(
        texts.mapInArrow(partial(_cells, wanted=wanted), "row long, core long, whole long, first long, last long"), "cells"
    )
    whole = cells.groupBy("whole").agg(
        F.count("*").alias("n"), F.min("core").alias("core"), F.min(F.struct("row", "first", "last")).alias("one")
    )
    whole = stored(whole.filter("n > 1"), "whole")
    done = cells.join(whole.select("whole"), "whole", "left_semi")
    cores = cells.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    edge = stored(cells.join(whole.select("whole"), "whole", "left_anti").join(cores, "core", "left_semi"), "edge")
    # windows at the edges may also equal one in a cell that is repeated as a whole: one of each such cell is enough
    same_core = whole.join(edge.select("core").distinct(), "core", "left_semi").select("one.*")
    compared = edge.select("row", "first", "last").union(same_core)
    moved = spark.sparkContext.broadcast(bit_filter(compared, F.col("row")))
    by_row = compared.distinct().groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("cells"))
    windows = stored(
        texts.mapInArrow(partial(_picked, wanted=moved, inside=True), texts.schema)
        .dropDuplicates(["row"])
        .join(by_row, "row")
        .select("row", "text", "cells")
        .mapInArrow(_windows, "row long, start long, window long"),
        "windows",
    )
    # a row that stands for several equal ones has its windows more than once
    again = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    single = windows.join(again, "window", "left_semi").select("row", F.col("start").alias("first"), F.col("start").alias("last"))
    return done.select("row", "first", "last").union(single)


def remove_repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): texts without the bytes of repeated strings.

    Each byte goes that lies in a string of ``LENGTH`` bytes which also starts elsewhere, in another document or
    the same; strings are judged on the input. ``kept`` is what remains, as bytes; ``n_spans`` counts the maximal
    removed runs. Null texts are empty ones; shorter texts lose nothing. Null ids are kept; repeated rows are
    documents of their own, so long ones are removed as a whole. Other columns are ignored; no documents give
    no rows.
    """
    spark = documents.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.xxhash64(F.col(doc_id), content).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), content.alias("text")
    )
    spans = repeated_spans(rows.select("row", "text")).distinct()
    by_row = stored(spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    hit = spark.sparkContext.broadcast(bit_filter(by_row, F.col("row")))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = rows.mapInArrow(partial(_picked, wanted=hit, inside=True), rows.schema).join(by_row, "row", "left")
    whole = rows.mapInArrow(partial(_picked, wanted=hit, inside=False), rows.schema).withColumn(
        "spans", F.lit(None).cast(by_row.schema["spans"].dataType)
    )
    columns = ("doc_id", "text", "spans")
    return changed.select(*columns).mapInArrow(_kept, result).union(whole.select(*columns).mapInArrow(_kept, result))
