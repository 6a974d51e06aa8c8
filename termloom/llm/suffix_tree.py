"""Language model scoring with a probabilistic suffix tree over words.

Contexts are the last one to ``DEPTH`` words. Every string of words that training texts hold at least ``LEAST`` times
is counted, whatever the size of the corpus: strings and states are stored tables that grow with it.

A context is retained if its next words diverge from those of its longest retained suffix by more than their
number explains (a description length test). A retained state gives a discounted share to the next words counted
in it and the rest to its suffix, down to the root, which knows every training word. A token is scored by the
longest retained suffix of what stands before it.

The logarithm of a token's probability is a sum over the strings that end at it or before it, so the score of a text
is the sum of the weights of all its strings. The weights of the most frequent strings, ``MOST`` at most, are broadcast;
this bounds the broadcast, not the model, and keeps hot keys out of the join. All other strings meet their weights in
a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.hashes import SortedHashes
from termloom.llm.scratch import bit_filter, dropped, in_filter, released, stored
from termloom.llm.words import hashed_words, mix, slices

DEPTH = 2
#: Least count of a string in the tree.
LEAST = 2
#: Most strings whose weights are broadcast.
MOST = 1_000_000
DISCOUNT = 0.75
#: Distinct strings that a task holds before it passes their counts on.
HELD = 2_000_000
#: Parts of the keys that meet their weights one after the other, so that only a part lies on disk at once.
TURNS = 4
#: By length of the longer string: how far the key of its first part is rotated.
_TURNS = (0, 7, 1)

_U = np.uint64
#: The token that ends every text: no word has this hash but by chance of 2**-64.
END = mix(np.array([0x454E44], _U))[0]


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, first token of each text) of slices of texts, with the ends."""
    for first, last, data, offsets in slices(texts):
        words, of = hashed_words(data, offsets)
        yield first, np.insert(words, of[1:], END), of + np.arange(last - first + 1)


def _joined(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """Keys of strings of ``level`` + 1 words from those of the strings without their last and their first word."""
    turn = _U(_TURNS[level])
    return ((left << turn) | (left >> (_U(64) - turn))) ^ right


def _joined_column(level: int) -> Column:
    turn = _TURNS[level]
    left = F.col("left")
    return F.shiftleft(left, turn).bitwiseOR(F.shiftrightunsigned(left, 64 - turn)).bitwiseXOR(F.col("right"))


def _strings(tokens: np.ndarray, begins: np.ndarray, levels: int = DEPTH + 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length, the keys of all strings and the tokens where they end. None reaches back over the begin of a text."""
    out = [(tokens, np.arange(len(tokens)))]
    place = np.arange(len(tokens)) - np.repeat(begins[:-1], np.diff(begins))
    whole = tokens
    for level in range(1, levels):
        whole = _joined(whole[:-1], whole[1:], level)
        at = np.flatnonzero(place[level:] >= level)
        out.append((whole[at], at + level))
    return out


def _added(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts n of the keys of all parts, passed on whenever ``HELD`` are at hand. Further arrays go with the keys.

    With further arrays, rows are ordered by the first half of the first of these: equal values that follow each other
    take little room in a shuffle. Keys with equal halves may then be passed on in several rows.
    """
    kept, counts = [np.zeros(0, _U) for _ in names], np.zeros(0, np.int64)
    fresh, size = [], 0

    def fold():
        both = [np.concatenate([k, *x]) for k, x in zip(kept, zip(*fresh))]
        n = np.concatenate([counts, np.ones(size, np.int64)])
        order = np.argsort(both[0] if len(both) == 1 else (both[1] >> _U(32) << _U(32)) | (both[0] >> _U(32)))
        keys = both[0][order]
        new = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
        return [x[order[new]] for x in both], np.add.reduceat(n[order], new)

    def batch():
        return pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in kept), pa.array(counts)], names=[*names, "n"])

    for part in parts:
        if len(part[0]) == 0:
            continue
        fresh.append(part)
        size += len(part[0])
        if size > HELD:
            kept, counts = fold()
            fresh, size = [], 0
            if len(counts) > HELD:
                yield batch()
                kept, counts = [k[:0] for k in kept], counts[:0]
    if fresh:
        kept, counts = fold()
    yield batch()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _added(((tokens,) for b in batches for _, tokens, _ in _tokens(b.column("text"))), ["key"])


def _count_strings(batches: Iterator[pa.RecordBatch], level: int, seen) -> Iterator[pa.RecordBatch]:
    """Counts (left, right, n) of the strings one word longer than ``level`` whose ends may be in the tree."""

    def parts():
        for batch in batches:
            for _, tokens, begins in _tokens(batch.column("text")):
                shorter, ends = _strings(tokens, begins, level)[-1]
                known = in_filter(seen.value, shorter)
                at = np.flatnonzero((np.diff(ends) == 1) & (known[:-1] & known[1:]))
                # ends that follow each other across the begin of a text
                if level == 1:
                    inner = np.ones(len(tokens), bool)
                    inner[begins[:-1]] = False
                    at = at[inner[ends[at + 1]]]
                left, right = shorter[at], shorter[at + 1]
                yield _joined(left, right, level), left, right

    for batch in _added(parts(), ["key", "left", "right"]):
        yield batch.select(["left", "right", "n"])


def _folded(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """(left, right, n) of one partition, which holds all of a string's counts -> those of at least ``LEAST`` in sum."""
    held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "n")] for b in batches if b.num_rows]
    if not held:
        return
    left, right, n = (np.concatenate(x) for x in zip(*held))
    held.clear()
    keys = _joined(left.view(_U), right.view(_U), level)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(n[order], new)
    often = sums >= LEAST
    at = order[new[often]]
    yield pa.RecordBatch.from_arrays([pa.array(left[at]), pa.array(right[at]), pa.array(sums[often])], names=["left", "right", "n"])


@dataclass
class Tree:
    """Stored tables of a tree.

    ``weights`` are (key, n, last, after) of all strings of the tree that weigh anything, and of all its words:
    logarithms that a string adds to its own last word and to the word that follows.
    """

    total: int
    distinct: int
    weights: DataFrame
    #: least count of the strings whose weights are broadcast
    least: int = LEAST

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def root_log(self, n: Column) -> Column:
        return F.log10((n + 0.5) / F.lit(self.total + 0.5 * (self.distinct + 1)))

    def frequent(self, least: int) -> tuple[SortedHashes, np.ndarray, np.ndarray]:
        """Lookup of the strings with so many counts, and their weights."""
        rows = self.weights.filter(F.col("n") >= least).select("key", "last", "after").toArrow()
        keys = rows["key"].to_numpy().view(_U)
        order = np.argsort(keys)
        return SortedHashes(keys[order], np.arange(len(keys))), rows["last"].to_numpy()[order], rows["after"].to_numpy()[order]

    @cached_property
    def _all(self) -> tuple[SortedHashes, np.ndarray, np.ndarray]:
        return self.frequent(0)

    def probabilities(self, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word of the tree of each token or -1, and its probability; for rare words, the factor of the root's.

        Gathers the whole tree: for looking at a small one. :func:`score` doesn't.
        """
        found, last, after = self._all
        logs, first = np.zeros(len(tokens)), None
        for keys, ends in _strings(tokens, begins):
            at = found.find(keys)
            first = at if first is None else first
            hit = np.flatnonzero(at >= 0)
            logs[ends[hit]] += last[at[hit]]
            follow = hit[(ends[hit] + 1 < len(tokens)) & ~np.isin(ends[hit] + 1, begins)]
            logs[ends[follow] + 1] += after[at[follow]]
        return first, 10**logs


def _settled(strings: DataFrame, contexts: DataFrame, lower: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Retained states (key, after) among ``contexts`` (key, n), and the strings (key, n, p, last) of the next length.

    ``lower`` are (right, lower): probabilities of the last words after the contexts without their first words.
    The strings of the last length leave out what their own successors would need. ``strings`` are deleted.
    """
    spark = strings.sparkSession
    n, c, low = F.col("n"), F.col("c"), F.col("lower")
    known = stored(strings.join(lower.hint("shuffle_hash"), "right"), f"strings{level}")
    dropped(strings)
    # sums by context first: few contexts, and not all strings, meet the contexts' own counts
    sums = known.groupBy("left").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("mass"), F.sum("lower").alias("spent"), F.sum(n * F.log(n / low)).alias("gain")
    )
    own = contexts.select(F.col("key").alias("left"), F.col("n").alias("c"))
    rest = F.greatest(c - F.col("mass"), F.lit(0))
    left = F.when(rest > 0, rest * F.log(rest / c / F.greatest(1.0 - F.col("spent"), F.lit(1e-300)))).otherwise(0.0)
    gain = F.col("gain") - F.col("mass") * F.log("c")
    retained = sums.hint("shuffle_hash").join(own, "left").filter(gain + left > F.col("kinds") * F.log("c") / 2)
    states = stored(retained.select("left", "c", ((rest + DISCOUNT * F.col("kinds")) / c).alias("passed")), f"states{level}")
    released(spark)
    passed = F.coalesce("passed", F.lit(1.0))
    p = F.when(F.col("passed").isNull(), low).otherwise((n - DISCOUNT) / c + passed * low)
    weighed = known.join(states.hint("shuffle_hash"), "left", "left").select(
        _joined_column(level).alias("key"), "n", p.alias("p"), (F.log10(p) - F.log10(passed * low)).alias("last")
    )
    weighed = stored(weighed.drop("p").filter("last <> 0") if level == DEPTH else weighed, f"weighed{level}")
    dropped(known)
    return states, weighed


def _least(weights: DataFrame) -> int:
    """The least count that at most ``MOST`` strings reach."""
    above = weights.groupBy("n").agg(F.count("*").alias("strings")).orderBy(F.desc("n")).toArrow()
    n, strings = (above[c].to_numpy().astype(np.int64) for c in ("n", "strings"))
    fits = n[np.cumsum(strings) <= MOST]
    return max(LEAST, int(fits[-1]) if len(fits) else int(n[0]) + 1 if len(n) else LEAST)


def train(documents: DataFrame, text: str = "text") -> tuple[Tree, DataFrame]:
    """The tree of all whole texts, and the (key, n) table of all training words.

    A null text is an empty one and counts as one end. No documents give a tree with the root alone.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(text).alias("text"))
    vocabulary = stored(texts.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    released(spark)
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    tree = Tree(sums["total"], sums["distinct"], None)
    root = F.pow(F.lit(10.0), tree.root_log(F.col("n")))
    # by length: strings (key, n, p, last) in the tree
    shorter = vocabulary.filter(F.col("n") >= LEAST).select("key", "n", root.alias("p"), tree.root_log(F.col("n")).alias("last"))
    weights, done = [], []
    # no more than HELD strings of a text pass meet in a task, on average
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tree.total // HELD + 1)
    for level in range(1, DEPTH + 1):
        seen = spark.sparkContext.broadcast(bit_filter(shorter, F.col("key")))
        counted = texts.mapInArrow(partial(_count_strings, level=level, seen=seen), "left long, right long, n long")
        dealt = counted.repartition(parts, "left", "right").mapInArrow(partial(_folded, level=level), counted.schema)
        strings = stored(dealt, f"counted{level}")
        seen.destroy()
        released(spark)
        states, longer = _settled(strings, shorter, shorter.select(F.col("key").alias("right"), F.col("p").alias("lower")), level)
        after = F.coalesce(F.log10("passed"), F.lit(0.0))
        keyed = states.select(F.col("left").alias("key"), "passed")
        part = shorter.join(keyed.hint("shuffle_hash"), "key", "left").select("key", "n", "last", after.alias("after"))
        # words of the tree are kept whatever they weigh
        weights.append(stored(part if level == 1 else part.filter("last <> 0 OR after <> 0"), "weights"))
        dropped(states, *done)
        shorter, done = longer, [longer]
    # nothing follows the longest strings
    weights.append(shorter.select("key", "n", "last", F.lit(0.0).alias("after")))
    tree.weights = reduce(DataFrame.union, weights)
    tree.least = _least(tree.weights)
    return tree, vocabulary


@dataclass
class _Frequent:
    """What tasks hold of a tree: the frequent words and strings, and a filter of the others."""

    words: tuple[SortedHashes, np.ndarray]
    strings: SortedHashes
    sums: np.ndarray
    others: np.ndarray


def _score(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) -> a row for each text with the sums over its frequent strings."""
    names = ["row", "doc_id", "times", "known", "score", "base"]
    model = tree.value
    words, roots = model.words
    for batch in batches:
        rows, ids = batch.column("row"), batch.column("doc_id")
        for first, tokens, begins in _tokens(batch.column("text")):
            n = len(begins) - 1
            word = words.find(tokens)
            known = word >= 0
            base = np.where(known, roots[word] if len(roots) else 0.0, 0.0)
            total = np.zeros(len(tokens))
            for keys, ends in _strings(tokens, begins):
                at = model.strings.find(keys)
                hit = np.flatnonzero(at >= 0)
                total[ends[hit]] += model.sums[at[hit]]
            sums = [np.add.reduceat(x, begins[:-1]) for x in (known.astype(np.int64), total, base)]
            yield pa.RecordBatch.from_arrays([rows.slice(first, n), ids.slice(first, n), pa.array(np.diff(begins)), *map(pa.array, sums)], names=names)


def _others(batches: Iterator[pa.RecordBatch], tree, turn: int) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, key, word, times) of the words and strings that aren't frequent and may weigh something.

    Only those whose keys are of this turn.
    """
    model = tree.value
    for batch in batches:
        rows = batch.column("row").to_numpy()
        for first, tokens, begins in _tokens(batch.column("text")):
            lengths = _strings(tokens, begins)
            for level, (keys, ends) in enumerate(lengths):
                at = np.flatnonzero((keys >> _U(56)) % _U(TURNS) == _U(turn))
                if level:
                    at = at[in_filter(model.others, keys[at])]
                if level > 1:
                    # a string weighs nothing unless its context is a state, and states weigh something
                    context, before = lengths[level - 1]
                    context = context[np.searchsorted(before, ends[at] - 1)]
                    at = at[in_filter(model.others, context) | (model.strings.find(context) >= 0)]
                at = at[(model.words[0] if level == 0 else model.strings).find(keys[at]) < 0]
                keys, text = keys[at], np.searchsorted(begins, ends[at], side="right") - 1
                order = np.lexsort((keys, text))
                keys, text = keys[order], text[order]
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(keys, prepend=_U(0)) != 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[first + text[new]]), pa.array(keys[new].view(np.int64)), pa.array(np.full(len(new), level == 0)),
                        pa.array(np.diff(new, append=len(keys)).astype(np.int32)),
                    ],
                    names=["row", "key", "word", "times"],
                )


def _turn(key: Column) -> Column:
    return F.shiftrightunsigned(key, 56) % TURNS


def score(documents: DataFrame, tree: Tree, vocabulary: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): log10 probabilities of every whole text, its end included.

    ``base_score`` is that of the root alone, ``score`` that of the tree. A null text is an empty one: its end.
    Null ids are kept, repeated rows give repeated rows; other columns are ignored; no documents give no rows.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select(
        F.xxhash64(F.col(doc_id), content).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), content.alias("text")
    )
    found, last, after = tree.frequent(tree.least)
    # a frequent word is also in the vocabulary, which says what its root's logarithm is
    words = vocabulary.filter(F.col("n") >= tree.least).toArrow()
    keys = words["key"].to_numpy().view(_U)
    order = np.argsort(keys)
    roots = np.log10(tree.root(words["n"].to_numpy()[order]))
    few = tree.weights.filter(F.col("n") < tree.least)
    model = _Frequent((SortedHashes(keys[order], np.arange(len(keys))), roots), found, last + after, bit_filter(few, F.col("key")))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    pieces = texts.mapInArrow(partial(_score, tree=shared), "row long, doc_id long, times long, known long, score double, base double")
    # equal rows have equal sums, and other strings that count as often as there are rows
    heads = pieces.groupBy("row", "doc_id").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("times", "known", "score", "base"))
    )
    # a word that is counted once has its root's logarithm and no more
    once = vocabulary.filter(F.col("n") < LEAST).select("key", "n", tree.root_log(F.col("n")).alias("weight"))
    weights = few.select("key", "n", (F.col("last") + F.col("after")).alias("weight")).union(once)
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    log = F.when(F.col("word"), tree.root_log(n)).otherwise(0.0)
    parts = []
    for turn in range(TURNS):
        others = texts.select("row", "text").mapInArrow(
            partial(_others, tree=shared, turn=turn), "row long, key long, word boolean, times int"
        )
        met = others.join(weights.filter(_turn(F.col("key")) == turn).hint("shuffle_hash"), "key", "left")
        sums = met.groupBy("row").agg(
            F.sum(F.when(F.col("word") & (n > 0), times).otherwise(0)).alias("more"), F.sum(log * times).alias("logs"),
            F.sum(F.coalesce(F.col("weight"), log) * times).alias("weights"),
        )
        parts.append(stored(sums, "rare"))
        released(documents.sparkSession)
    rare = reduce(DataFrame.union, parts).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "logs", "weights")))
    more, logs, weighed = F.coalesce(F.col("more"), F.lit(0)), F.coalesce(F.col("logs"), F.lit(0.0)), F.coalesce(F.col("weights"), F.lit(0.0))
    return heads.join(rare, "row", "left").select(
        "doc_id", F.col("times").alias("n_tokens"), (F.col("known") + (more / F.col("copies")).cast("long")).alias("n_known"),
        (F.col("base") + logs / F.col("copies")).alias("base_score"), (F.col("score") + weighed / F.col("copies")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def score_held_out(documents: DataFrame) -> DataFrame:
    """Scores of all documents by a tree learned from those that aren't held out."""
    tree, vocabulary = train(documents.filter(~held_out(F.col("doc_id"))))
    return score(documents, tree, vocabulary).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
