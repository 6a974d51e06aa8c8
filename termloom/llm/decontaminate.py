"""Benchmark decontamination: SimHash fingerprints of item-sized windows, looked up by Hamming blocks.

Every window of a document that has about as many word shingles as an item gets a 64-bit SimHash. Four blocks
of 16 bits are indexed with all values within ``RADIUS // 4`` bits of an item's block: fingerprints within
``RADIUS`` agree with the item so far in one block at least, so none of them is missed. What the index finds
and the whole fingerprint confirms is then measured: the shingles, weighted by how often they occur, of the
windows around it that are exactly as long as the item.

Sizes of windows lie at most a tenth apart, and starts up to a sixteenth of a window. A verbatim passage is
always well within the radius; a passage at the bound of similarity may lie outside with some probability,
as with any SimHash.

Counters of all 64 bits are added at once, as bit planes: plane i holds bit i of 64 counters.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import hashed_words, slices, utf8, window_hashes

RADIUS = 15
BLOCKS = 4
#: Items matched in one pass over the documents; more items take more passes, and none is a larger broadcast.
ITEMS_AT_ONCE = 2_000
#: Positions whose bit planes are worked on at once, to stay in the processor's cache.
CHUNK = 4_096

_U = np.uint64


def _add(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two numbers given as bit planes."""
    out, carry = [], None
    for i in range(max(len(x), len(y))):
        a, b = (x[i] if i < len(x) else None), (y[i] if i < len(y) else None)
        if a is None or b is None:
            one = a if b is None else b
            out.append(one if carry is None else one ^ carry)
            carry = None if carry is None else one & carry
        elif carry is None:
            out.append(a ^ b)
            carry = a & b
        else:
            differ = a ^ b
            out.append(differ ^ carry)
            carry = (a & b) | (differ & carry)
    return out if carry is None else [*out, carry]


def _above(planes: list[np.ndarray], bound: int) -> np.ndarray:
    """Bits of the counters that are greater than ``bound``."""
    above = np.zeros_like(planes[0])
    equal = ~above
    for i in reversed(range(max(len(planes), bound.bit_length()))):
        plane = planes[i] if i < len(planes) else np.zeros_like(above)
        if bound >> i & 1:
            equal = equal & plane
        else:
            above |= equal & plane
            equal = equal & ~plane
    return above


def fingerprints(grams: np.ndarray, sizes: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """SimHash of ``grams[p : p + n]`` for p = 0, step, 2 step, …, for each (n, step) of ``sizes``."""
    doubles = [[grams]]
    while 2 << (len(doubles) - 1) <= max(n for n, _ in sizes):
        half = 1 << (len(doubles) - 1)
        last = doubles[-1]
        doubles.append(_add([x[:-half] for x in last], [x[half:] for x in last]) if len(last[0]) > half else [grams[:0]])
    for n, step in sizes:
        count = len(grams) - n + 1
        if count <= 0:
            yield grams[:0]
            continue
        total, at = None, 0
        for i in reversed(range(n.bit_length())):
            if n >> i & 1:
                part = [x[at : at + count : step] for x in doubles[i]]
                total = part if total is None else _add(total, part)
                at += 1 << i
        yield _above(total, n // 2)


def _near(bits: int) -> np.ndarray:
    """All 16-bit values with at most ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in itertools.combinations(range(16), k)], np.int64)


class _Size:
    """Items of similar size: (number of shingles of a window, step) and the tables of their blocks."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        smallest, largest = (f(len(grams) for _, grams in items) for f in (min, max))
        self.items, self.smallest = items, smallest
        self.window = (smallest + largest) // 2
        self.step = max(1, self.window // 16)
        self.prints = [int(next(fingerprints(grams, [(len(grams), 1)]))[0]) for _, grams in items]
        self.values = np.array(self.prints, _U)
        self.tables = np.zeros((BLOCKS, 1 << 16), np.uint32)
        masks = _near(RADIUS // BLOCKS)
        for i, value in enumerate(self.prints):
            for block in range(BLOCKS):
                self.tables[block][(value >> (16 * block) & 0xFFFF) ^ masks] |= np.uint32(1 << i)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place of an item, places of the fingerprints within the radius of it)."""
        blocks = prints.astype("<u8", copy=False).view("<u2").reshape(-1, BLOCKS)
        found = self.tables[0][blocks[:, 0]]
        for block in range(1, BLOCKS):
            found |= self.tables[block][blocks[:, block]]
        at = np.flatnonzero(found)
        found, near = found[at], prints[at]
        items, places = [], []
        # one item of each entry at a time, the lowest bit first
        while len(at):
            rest = found & (found - np.uint32(1))
            item = np.bitwise_count((found ^ rest) - np.uint32(1))
            hit = np.flatnonzero(np.bitwise_count(near ^ self.values[item]) <= RADIUS)
            items.append(item[hit])
            places.append(at[hit])
            more = np.flatnonzero(rest)
            at, found, near = at[more], rest[more], near[more]
        if items:
            item, place = np.concatenate(items), np.concatenate(places)
            for i in np.unique(item):
                yield int(i), np.sort(place[item == i])


class _Index:
    """All items by width of shingle and size of window."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        data, offsets = utf8(pa.array([text for _, text in items], pa.string()))
        words, of = hashed_words(data, offsets)
        by_width: dict[int, list] = {}
        for k, (item, _) in enumerate(items):
            own = words[of[k] : of[k + 1]]
            if len(own):
                w = min(width, len(own))
                by_width.setdefault(w, []).append((item, window_hashes(own, w)))
        self.widths = {w: self._sizes(sorted(group, key=lambda x: len(x[1]))) for w, group in by_width.items()}

    @staticmethod
    def _sizes(items: list) -> list[_Size]:
        out, start = [], 0
        for i in range(1, len(items) + 1):
            # at most 32 items, one for each bit of a table's entry
            if i == len(items) or len(items[i][1]) * 10 > len(items[start][1]) * 11 or i - start == 32:
                out.append(_Size(items[start:i]))
                start = i
        return out


def _weighted(grams: np.ndarray, weights: Counter, total: int) -> float:
    """Weighted Jaccard similarity of a window's shingles and an item's."""
    shared = sum((Counter(grams.tolist()) & weights).values())
    return shared / (len(grams) + total - shared)


def _best(grams: np.ndarray, item: np.ndarray, places: np.ndarray, slack: int, similarity: float) -> tuple[float, int] | None:
    """The best similarity, and the earliest start with it, of item-sized windows near the given places."""
    n, weights, best = len(item), Counter(item.tolist()), None
    size = min(n, len(grams))
    starts = np.unique(np.clip(places[:, None] + np.arange(-slack, slack + 1), 0, len(grams) - size))
    shared = np.concatenate([[0], np.cumsum(np.isin(grams, item))])
    # a window shares at most its shingles that the item has at all
    most = shared[starts + size] - shared[starts]
    for start in starts[most >= similarity * n]:
        value = _weighted(grams[start : start + size], weights, n)
        if value >= similarity and (best is None or value > best[0]):
            best = value, int(start)
    return best


def _matches(texts: pa.Array, index: _Index, similarity: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) for every document and item that match."""
    for first, _, data, offsets in slices(texts):
        words, of = hashed_words(data, offsets)
        for width, sizes in index.widths.items():
            parts = [window_hashes(words[a:b], width) for a, b in zip(of[:-1], of[1:], strict=True)]
            ends = np.cumsum([len(p) for p in parts])
            begins = ends - [len(p) for p in parts]
            grams = np.concatenate(parts) if parts else words
            found: dict[tuple[int, int, int], list[np.ndarray]] = {}
            for s, (prints, starts) in zip(sizes, _all_prints(grams, sizes), strict=True):
                for i, at in s.candidates(prints):
                    places = starts[at]
                    # a window may reach over the ends of its document by less than a step
                    row = np.searchsorted(ends, places + s.window // 2, side="right")
                    inside = (places > begins[row] - s.step) & (places + s.window < ends[row] + s.step)
                    for r in np.unique(row[inside]):
                        found.setdefault((int(r), id(s), i), []).append(places[inside & (row == r)])
            by_id = {id(s): s for s in sizes}
            for r, part in enumerate(parts):
                for s in sizes:
                    # a document shorter than the window is one window
                    if 0 < len(part) < s.window and len(part) >= similarity * s.smallest:
                        for i, _ in s.candidates(next(fingerprints(part, [(len(part), 1)]))):
                            found.setdefault((r, id(s), i), []).append(begins[r : r + 1])
            for (r, s, i), places in sorted(found.items(), key=lambda x: x[0][0]):
                item, item_grams = by_id[s].items[i]
                slack = by_id[s].step + abs(len(item_grams) - by_id[s].window) + 1
                local = np.concatenate(places) - begins[r]
                if best := _best(parts[r], item_grams, local, slack, similarity):
                    yield first + r, item, best[0], best[1], min(len(item_grams), len(parts[r])) + width - 1


def _all_prints(grams: np.ndarray, sizes: list[_Size]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints and starts of the windows of each size; the windows are made chunk by chunk."""
    longest = max(s.window for s in sizes)
    prints, starts = [[grams[:0]] for _ in sizes], [[np.zeros(0, np.int64)] for _ in sizes]
    for at in range(0, len(grams), CHUNK):
        piece = grams[at : at + CHUNK + longest - 1]
        for k, part in enumerate(fingerprints(piece, [(s.window, s.step) for s in sizes])):
            part = part[: -(-CHUNK // sizes[k].step)]
            prints[k].append(part)
            starts[k].append(at + sizes[k].step * np.arange(len(part)))
    return [(np.concatenate(p), np.concatenate(s)) for p, s in zip(prints, starts, strict=True)]


_INDEXES: dict[str, _Index] = {}


def _index(items, width: int) -> _Index:
    """The index of broadcast items, built once in a worker."""
    name, block = items.value
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = _Index(block, width)
    return _INDEXES[name]


_FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _report(batches: Iterator[pa.RecordBatch], items, width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_matches(batch.column("text"), _index(items, width), similarity))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))],
            names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
        )


def _clean(batches: Iterator[pa.RecordBatch], items, width: int, similarity: float, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(len(batch), bool)
        keep[[row for row, *_ in _matches(batch.column(text), _index(items, width), similarity)]] = False
        yield batch.filter(pa.array(keep))


def _item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size. Null ids and texts are no items."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).dropna()
    blocks = max(1, -(-items.count() // ITEMS_AT_ONCE))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], r["text"]) for r in part.distinct().collect()]


def contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", width: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): documents with a window like an item.

    One row for each document and item: the most similar window and, of several, the first. Words are compared
    with A-Z in lower case; an item or a text with fewer than ``width`` words is one shingle. Null and empty
    texts match nothing, nor do items without words; a repeated document is reported as often as it occurs,
    a repeated item once. Other columns are ignored; empty tables give an empty result.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _item_blocks(benchmark, item_id, item_text):
        items = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        part = texts.mapInArrow(partial(_report, items=items, width=width, similarity=similarity), _FOUND)
        out = part if out is None else out.union(part)
    return out


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
    width: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """The documents without those that :func:`contaminated` reports, with all their columns."""
    spark = documents.sparkSession
    for block in _item_blocks(benchmark, item_id, item_text):
        items = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        documents = documents.mapInArrow(
            partial(_clean, items=items, width=width, similarity=similarity, text=text), documents.schema
        )
    return documents
