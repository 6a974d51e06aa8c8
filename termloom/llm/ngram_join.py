"""N-gram Jaccard join: a blocked product of the sparse document by n-gram matrix.

Documents with equal n-gram sets are one row of the matrix (a class). A pair of classes of sizes m <= n
reaches similarity t only if m >= t n and if the pair meets in a column among the first
n - ceil(t n) + 1 of each row, under any one order of the columns. So only those entries are shuffled.
The order puts columns with many entries last; ties go by hash. Each column gives the pairs that meet. The
columns also form ``BLOCKS`` blocks: two rows can't share more of a block than the smaller of their counts
in it, so the sum of these bounds the overlap, and most pairs that meet by chance are dropped without
their sets. The whole overlap of the others is counted, and pairs below the bound are dropped.

A column with more than ``WIDE`` rows isn't multiplied out. Its rows are first tried against a few pivots, the
rows with the smallest hashes of each range of sizes, so that columns of the same rows agree on them. Components
of these links are found. Of columns that hold several components, rows of different components are tried against
each other, range by range. No link between components is lost, and copies of one text by the thousand meet a
few of them each, not all.

Keys of columns and classes are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import components
from termloom.llm.scratch import bit_filter, dropped, in_filter, stored
from termloom.llm.words import hashed_words, mix, shingles, slices

#: A column is frequent, and comes last in the order, from so many entries on.
FREQUENT = 64
#: Columns with more rows than this are tried against pivots first.
WIDE = 32
#: Pivots of each range of sizes in a wide column.
PIVOTS = 2
#: Blocks of columns whose sizes bound the overlap of two rows.
BLOCKS = 256
#: N-grams that a task holds before it counts and drops them.
HELD = 2_000_000

_U = np.uint64


def _class_key(grams: np.ndarray) -> int:
    """Key of a set of n-grams, whatever their order; never 0."""
    total = np.add.reduce(mix(grams ^ _U(0x5851F42D4C957F2D)), dtype=_U, keepdims=True)
    return int(mix(total + mix(np.array([len(grams)], _U))).view(np.int64)[0]) or 1


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row in the batch, sorted distinct n-grams) of every text."""
    for first, last, data, offsets in slices(batch.column("text")):
        words, of = hashed_words(data, offsets)
        for row in range(first, last):
            yield row, np.unique(shingles(words[of[row - first] : of[row - first + 1]], width))


def _survey(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, row, n, key) for every document, with the sizes of its blocks once for each class in a task;
    (gram, count) rows of n-grams that a task meets again."""
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "row", "n", "key")] + [("blocks", pa.binary()), ("gram", pa.int64()), ("count", pa.int64())]
    )
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def again() -> pa.RecordBatch:
        grams = np.concatenate([*held, np.zeros(0, _U)])
        held.clear()
        grams.sort()
        same = grams[1:] == grams[:-1]
        # most n-grams occur once, and are left out before anything else of their number is made
        grams, counts = np.unique(grams[np.append(same, False)[: len(grams)]], return_counts=True)
        empty = pa.nulls(len(grams), pa.int64())
        return pa.RecordBatch.from_arrays(
            [empty, empty, empty, empty, pa.nulls(len(empty), pa.binary()), pa.array(grams.view(np.int64)), pa.array(counts + 1)],
            schema=schema,
        )

    for batch in batches:
        sizes, keys = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        blocks: list[bytes | None] = [None] * len(batch)
        for row, grams in _sets(batch, width):
            sizes[row] = len(grams)
            if len(grams) == 0:
                continue
            keys[row] = key = _class_key(grams)
            if key not in seen:
                seen.add(key)
                counts = np.bincount((grams >> _U(56)).astype(np.int64), minlength=BLOCKS)
                blocks[row] = np.minimum(counts, 255).astype(np.uint8).tobytes()
                held.append(grams)
                size += len(grams)
                if size > HELD:
                    yield again()
                    size = 0
        none = pa.nulls(len(batch), pa.int64())
        ids = batch.column("doc_id").cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("row"), pa.array(sizes), pa.array(keys), pa.array(blocks, pa.binary()), none, none], schema=schema
        )
    yield again()


def _entries(batches: Iterator[pa.RecordBatch], width: int, similarity: Fraction, frequent) -> Iterator[pa.RecordBatch]:
    """The entries (gram, key, n) in the first columns of each class, once in a task."""
    seen: set[int] = set()
    for batch in batches:
        grams_out, keys_out, sizes_out = [], [], []
        for _, grams in _sets(batch, width):
            n = len(grams)
            if n == 0 or (key := _class_key(grams)) in seen:
                continue
            seen.add(key)
            last = in_filter(frequent.value, grams)
            columns = n + (-n * similarity.numerator // similarity.denominator) + 1
            grams_out.append(np.concatenate([grams[~last], grams[last]])[:columns])
            keys_out.append(np.full(columns, key))
            sizes_out.append(np.full(columns, n))
        if grams_out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(grams_out).view(np.int64)), pa.array(np.concatenate(keys_out)), pa.array(np.concatenate(sizes_out))],
                names=["gram", "key", "n"],
            )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole batches, the rows of the last gram held back until it is complete."""
    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest


def _range_width(similarity: float) -> float:
    """Width of a range of sizes on the scale of logarithms: rows that can link lie in one range or in neighbours."""
    return max(-math.log(similarity), 0.05) * (1 + 1e-6)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gram", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def _pair_rows(a: list, b: list) -> pa.RecordBatch:
    one, two = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    both = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
    none = pa.nulls(len(both), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), none, none, none], schema=_PAIRS)


def _meet(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (gram, n) -> pairs that meet in a column; wide columns give pivots and their own rows."""
    for grams, keys, sizes in _runs(batches):
        first = np.flatnonzero(np.diff(grams, prepend=grams[0] - 1))
        counts = np.diff(first, append=len(grams))
        a, b, wide = [], [], []
        for step in range(1, WIDE):
            # rows i and i + step of the same column, sizes not too far apart
            runs = (counts > step) & (counts <= WIDE)
            if not runs.any():
                break
            at, n = first[runs], counts[runs] - step
            i = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            i = i[(sizes[i] >= similarity * sizes[i + step] - 1e-6) & (keys[i] != keys[i + step])]
            a.append(keys[i])
            b.append(keys[i + step])
        for at, n in zip(first[counts > WIDE], counts[counts > WIDE], strict=True):
            k, s = keys[at : at + n], sizes[at : at + n]
            wide.append((grams[at : at + n], k, s))
            order = mix(k.view(_U))
            ranges = np.floor(np.log(s) / _range_width(similarity)).astype(np.int64)
            begin = np.flatnonzero(np.diff(ranges, prepend=-1))
            end = np.append(begin[1:], n)
            for i, (low, high) in enumerate(zip(begin, end, strict=True)):
                # pivots meet the rows of their own range and of the one above
                above = i + 1 < len(begin) and ranges[high] == ranges[low] + 1
                top = end[i + 1] if above else high
                for pivot in low + np.argsort(order[low:high], kind="stable")[:PIVOTS]:
                    near = (np.minimum(s[low:top], s[pivot]) >= similarity * np.maximum(s[low:top], s[pivot]) - 1e-6)
                    near = low + np.flatnonzero(near & (k[low:top] != k[pivot]))
                    a.append(k[near])
                    b.append(np.full(len(near), k[pivot]))
        yield _pair_rows(a, b)
        if wide:
            columns = [np.concatenate(c) for c in zip(*wide, strict=True)]
            none = pa.nulls(len(columns[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, columns)], schema=_PAIRS)


def _meet_across(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, key, n, label, home, blocks) of wide columns -> pairs of different labels whose blocks leave room.

    A cell is a range of sizes of a column: rows at home there, and those of the range below as guests.
    """
    for cells, keys, sizes, labels, homes, blocks in _runs(batches):
        first = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
        for at, n in zip(first, np.diff(first, append=len(cells)), strict=True):
            k, s, l, home = (c[at : at + n] for c in (keys, sizes, labels, homes))
            values, often = np.unique(l, return_counts=True)
            if len(values) == 1:
                continue
            counts = np.frombuffer(b"".join(blocks[at : at + n]), np.uint8).reshape(-1, BLOCKS)
            # 255 stands for that many or more, and bounds nothing
            open_ended = (counts == 255).any(axis=1)
            a, b = [], []
            # every pair of different labels holds a row that is not of the commonest label
            for i in np.flatnonzero(l != values[often.argmax()]):
                near = (l != l[i]) & (np.minimum(s, s[i]) >= similarity * np.maximum(s, s[i]) - 1e-6)
                near = np.flatnonzero(near if home[i] else near & home)
                most = np.minimum(counts[near], counts[i]).sum(axis=1, dtype=np.int64)
                room = most * (1 + similarity) >= similarity * (s[near] + s[i]) - 1e-6
                near = near[room | open_ended[near] | open_ended[i]]
                a.append(np.full(len(near), k[i]))
                b.append(k[near])
            yield _pair_rows(a, b)


def _whole_sets(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[pa.RecordBatch]:
    """(key, grams) of the classes in the filter, once in a task."""
    seen: set[int] = set()
    for batch in batches:
        keys, sets = [], []
        for _, grams in _sets(batch, width):
            if len(grams) and (key := _class_key(grams)) not in seen and in_filter(wanted.value, np.array([key]))[0]:
                seen.add(key)
                keys.append(key)
                sets.append(grams.astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "grams"])


def _linked(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets -> the pairs whose overlap reaches the bound."""
    for batch in batches:
        keep = []
        for i, (one, two) in enumerate(zip(batch.column("grams_a"), batch.column("grams_b"), strict=True)):
            x, y = np.frombuffer(one.as_buffer(), "<u8"), np.frombuffer(two.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * similarity.denominator >= similarity.numerator * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _possible(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes and block sizes of both -> the pairs whose blocks leave room for the bound."""
    for batch in batches:
        counts = [
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BLOCKS).astype(np.int64)
            for c in ("blocks_a", "blocks_b")
        ]
        # 255 stands for that many or more
        counts = [np.where(c == 255, 1 << 40, c) for c in counts]
        most = np.minimum(*counts).sum(axis=1)
        together = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        keep = most * (1 + similarity) >= similarity * together - 1e-6
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """Pairs (a, b) of classes -> those that link. Sets are shipped for classes in a possible pair only."""
    spark = pairs.sparkSession
    sized = (
        pairs.distinct()
        .join(classes.toDF("a", "n_a", "blocks_a"), "a")
        .join(classes.toDF("b", "n_b", "blocks_b"), "b")
        .mapInArrow(partial(_possible, similarity=float(similarity)), "a long, b long")
    )
    pairs = stored(sized, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    wanted = spark.sparkContext.broadcast(bit_filter(ends, F.col("key")))
    sets = texts.mapInArrow(partial(_whole_sets, width=width, wanted=wanted), "key long, grams binary")
    sets = sets.dropDuplicates(["key"])
    both = (
        pairs.join(sets.toDF("a", "grams_a"), "a")
        .join(sets.toDF("b", "grams_b"), "b")
        .select("a", "b", "grams_a", "grams_b")
    )
    links = stored(both.mapInArrow(partial(_linked, similarity=similarity), "a long, b long"), "links")
    dropped(pairs)
    return links


def _row(text: str, doc_id: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def ngram_join(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: str = "0.8"
) -> tuple[DataFrame, DataFrame]:
    """Self-join of documents by the Jaccard similarity of their n-gram sets.

    Returns ``members`` (doc_id, row, n, key): one row for each document with a hash of its id and text, the size
    of its set and the key of its class, and ``links`` (a, b) between classes: spanning links, which give all
    components, and every link of classes that meet in a column with at most ``WIDE`` rows.

    A null or empty text, or one without words, has an empty set, class 0, and links with nothing. A text
    with fewer than ``width`` words is one n-gram. Repeated rows are members of one class; other columns are
    ignored. An empty table gives two empty frames.
    """
    spark = documents.sparkSession
    bound = Fraction(similarity)
    texts = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), _row(text, doc_id).alias("row"), F.col(text).alias("text")
    )
    surveyed = stored(
        texts.mapInArrow(
            partial(_survey, width=width), "doc_id long, row long, n long, key long, blocks binary, gram long, count long"
        ),
        "survey",
    )
    classes = surveyed.filter("blocks IS NOT NULL").select("key", "n", "blocks").dropDuplicates(["key"])
    members = surveyed.filter("key IS NOT NULL").select("doc_id", "row", "n", "key")
    common = surveyed.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("count").alias("count"))
    frequent = spark.sparkContext.broadcast(bit_filter(common.filter(F.col("count") >= FREQUENT), F.col("gram")))
    entries = texts.select("text").mapInArrow(
        partial(_entries, width=width, similarity=bound, frequent=frequent), "gram long, key long, n long"
    )
    met = stored(
        entries.repartition("gram")
        .sortWithinPartitions("gram", "n", "key")
        .mapInArrow(partial(_meet, similarity=float(bound)), "a long, b long, gram long, key long, n long"),
        "met",
    )
    links = _verified(met.filter("a IS NOT NULL").select("a", "b"), classes, texts, width, bound)
    wide = met.filter("gram IS NOT NULL").select("gram", "key", "n").distinct()
    if not wide.isEmpty():
        labels = components(links).withColumnRenamed("node", "key")
        labelled = wide.join(labels, "key", "left").select("gram", "key", "n", F.coalesce("label", "key").alias("label"))
        labelled = stored(labelled, "wide")
        dropped(met)
        several = labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        place = F.floor(F.log("n") / F.lit(_range_width(float(bound))))
        across = (
            labelled.join(several.filter("low <> high").select("gram"), "gram", "left_semi")
            .join(classes.select("key", "blocks"), "key")
            .withColumn("home", F.explode(F.array(F.lit(True), F.lit(False))))
            .select(
                F.xxhash64("gram", place + F.when(F.col("home"), 0).otherwise(1)).alias("cell"),
                "key", "n", "label", "home", "blocks",
            )
            .repartition("cell")
            .sortWithinPartitions("cell", "n", "key")
            .mapInArrow(partial(_meet_across, similarity=float(bound)), "a long, b long, gram long, key long, n long")
        )
        links = links.union(_verified(across.select("a", "b"), classes, texts, width, bound))
    return members, links


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with words, with the label of their component."""
    labels = components(links).withColumnRenamed("node", "key")
    return members.filter("n > 0").join(labels, "key", "left").select(
        "doc_id", "row", "n", F.coalesce("label", "key").alias("label")
    )


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the smallest doc_id that links lead to.

    Members of a class count as linked; documents without words are linked with nothing, themselves
    included only. Null ids stay null and are never the smallest; a component without an id has none.
    """
    members, links = ngram_join(documents, **options)
    labelled = _labelled(members, links)
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    with_words = labelled.join(smallest, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    without = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.union(without)


def _picked(batches: Iterator[pa.RecordBatch], wanted, inside: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose hash is in the filter, or those whose isn't."""
    for batch in batches:
        keep = in_filter(wanted.value, batch.column("row").to_numpy()) == inside
        yield batch.filter(pa.array(keep))


def distinct_documents(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each component with all its columns: the one with the smallest id, ids before nulls.

    Of repeated rows one stays. Documents without words all stay. Only the texts of documents that may go are
    shuffled: the others pass a bit filter.
    """
    members, links = ngram_join(documents, text, doc_id, **options)
    labelled = stored(_labelled(members, links), "labelled")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    first = labelled.groupBy("label").agg(F.min_by("row", order).alias("first"))
    tagged = labelled.join(first, "label")
    losers = tagged.filter("row <> first").select("row").distinct()
    repeated = labelled.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    goes = documents.sparkSession.sparkContext.broadcast(bit_filter(losers.union(repeated), F.col("row")))
    # the columns stay in a struct of their own, whatever their names
    rows = documents.select(F.struct(*documents.columns).alias("document"), _row(text, doc_id).alias("row"))
    stay = rows.mapInArrow(partial(_picked, wanted=goes, inside=False), rows.schema)
    maybe = rows.mapInArrow(partial(_picked, wanted=goes, inside=True), rows.schema).join(losers, "row", "left_anti")
    once = maybe.join(repeated, "row", "left_semi").dropDuplicates(["row"])
    other = maybe.join(repeated, "row", "left_anti")
    columns = ("document", "row")
    return stay.select(*columns).union(once.select(*columns)).union(other.select(*columns)).select("document.*")
