"""Spelling variants: words one edit apart, found by sorting permuterm rotations.

A word with a terminator behind it is rotated to every place. The rotation that brings a character to the end
has in front of it a prefix which skips that character: words that differ there alone share the prefix, and a word
without the character has the prefix as a whole rotation. So all rotations are sorted over the cluster, once with the
last character skipped and once whole, and a scan finds the neighbours side by side. The letters that can be skipped
bound a group of equal prefixes, and the scan keeps the best two of a group, so that no pairs are formed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.scratch import stored

#: A word whose document and text have a checksum that this divides is misspelt on purpose.
DAMAGE = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Rotations longer than this are sorted by a hash of them: all rotations of a word take the square of its length.
SPELT = 64

_RUN = re.compile("[a-zÀ-ÿ]+")
_END = "$"
# a Mersenne prime, and a base below it
_PRIME = (1 << 127) - 1
_BASE = 0x5851F42D4C957F2D14057B7EF767814F % _PRIME


def _runs(batches: Iterator[pa.RecordBatch], least: int, damage: int) -> Iterator[pa.RecordBatch]:
    """(id as text, text) -> (word, n) of each batch."""
    for batch in batches:
        total: Counter = Counter()
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            begin = zlib.crc32(f"{doc_id}:".encode())
            # lower() of bytes leaves all but A-Z alone
            for word, n in Counter(_RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                # a lost character only makes a word shorter
                if len(word) < least:
                    continue
                check = zlib.crc32(word.encode(), begin)
                if check % damage == 0:
                    place = check % len(word)
                    word = word[:place] + word[place + 1 :]
                    if len(word) < least:
                        continue
                total[word] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )


def damaged_words(
    documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(word, n): the letter runs of all texts with A-Z in lower case, some of them without one character.

    A run loses the character at ``h`` modulo its length where ``damage`` divides h, the checksum of its document's id
    and the run. A null id is an empty one; a null text has no runs; repeated rows count again.
    """
    rows = documents.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    counts = rows.mapInArrow(lambda b: _runs(b, least_length, damage), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _rotations(words: DataFrame) -> DataFrame:
    """(rotation, skipped, name, n, first): rotations of at most ``SPELT`` characters and the terminator.

    ``skipped`` is the character left out, empty for a whole rotation; ``first`` says that the character isn't
    the same as the one before it, whose loss would give the same word. ``name`` is null: prefix and character tell it.
    """
    word, length = F.col("word"), F.length("word")

    def tail(start):
        return F.substring(word, start, length)

    def skip(i):
        own = F.substring(word, i, F.lit(1))
        return F.struct(
            F.concat(tail(i + 1), F.lit(_END), F.substring(word, F.lit(1), i - 1)).alias("rotation"),
            own.alias("skipped"),
            ((i == 1) | (own != F.substring(word, i - 1, F.lit(1)))).alias("first"),
        )

    def whole(i):
        return F.struct(
            F.concat(tail(i), F.lit(_END), F.substring(word, F.lit(1), i - 1)).alias("rotation"),
            F.lit("").alias("skipped"),
            F.lit(True).alias("first"),
        )

    skips = F.transform(F.sequence(F.lit(1), length), skip)
    wholes = F.when(length < SPELT, F.transform(F.sequence(F.lit(1), length + 1), whole)).otherwise(F.array().cast(
        "array<struct<rotation:string,skipped:string,first:boolean>>"))
    return words.filter((length > 0) & (length <= SPELT)).select(
        F.inline(F.concat(skips, wholes)), F.lit(None).cast("string").alias("name"), "n"
    ).select("rotation", "skipped", "name", "n", "first")


def _hashed_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longer rotations of long words (word, n, name): two rows for each character, whatever its length."""
    for batch in batches:
        for word, n, name in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "name")), strict=True):
            power, before = [1], [0]
            for c in word:
                power.append(power[-1] * _BASE % _PRIME)
                before.append((before[-1] * _BASE + ord(c)) % _PRIME)
            size, rows = len(word), []
            # whole rotations are one character longer than those that skip one
            for step in (0, 1) if size > SPELT else (0,):
                for i in range(size + 1 - step):
                    tail = (before[size] - before[i + step] * power[size - i - step]) % _PRIME
                    key = ((tail * _BASE + ord(_END)) * power[i] + before[i]) % _PRIME
                    skipped = word[i] if step else ""
                    rows.append((f"~{key:032x}", skipped, not step or i == 0 or word[i - 1] != skipped))
            rotation, skipped, first = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rotation), pa.array(skipped), pa.array([name] * len(rows)), pa.array([n] * len(rows), pa.int64()), pa.array(first)],
                names=["rotation", "skipped", "name", "n", "first"],
            )


def _named(rotation: str, skipped: str) -> str:
    tail, head = rotation.split(_END)
    return head + skipped + tail


def _met(rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """One group of equal rotations -> (name, neighbours, n of the best neighbour, its name) of each member that has one."""
    ends = [(name or _named(rotation, skipped), n, first) for rotation, skipped, name, n, first in rows if skipped]
    whole = next(((name or _named(rotation, skipped), n) for rotation, skipped, name, n, _ in rows if not skipped), None)
    two = sorted((-n, name) for name, n, _ in ends)[:2]
    if whole is not None:
        shorter = min(((-n, name) for name, n, first in ends if first), default=None)
        if shorter is not None:
            yield whole[0], sum(first for *_, first in ends), -shorter[0], shorter[1]
    for name, n, first in ends:
        others = [x for x in two if x[1] != name]
        found = len(ends) - 1
        if whole is not None and first:
            others.append((-whole[1], whole[0]))
            found += 1
        if found:
            best = min(others)
            yield name, found, -best[0], best[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations -> what each group of equal ones tells of its members. The last group waits for the next batch."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())

    def told(table: pa.Table) -> pa.RecordBatch:
        found = []
        if len(table) > 1:
            rotation = table.column("rotation").combine_chunks()
            new = np.concatenate([[True], pc.not_equal(rotation[1:], rotation[:-1]).to_numpy(zero_copy_only=False)])
            begins = np.flatnonzero(new)
            sizes = np.diff(begins, append=len(table))
            # nearly all rotations stand alone
            some = sizes > 1
            taken = table.take(pa.array(np.flatnonzero(np.repeat(some, sizes))))
            rows = list(zip(*(taken.column(c).to_pylist() for c in ("rotation", "skipped", "name", "n", "first")), strict=True))
            at = 0
            for size in sizes[some].tolist():
                found.extend(_met(rows[at : at + size]))
                at += size
        columns = zip(*found, strict=True) if found else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["name", "near", "best_n", "best"]
        )

    waiting = None
    for batch in batches:
        if len(batch) == 0:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        rotation = table.column("rotation").combine_chunks()
        other = np.flatnonzero(pc.not_equal(rotation, rotation[-1]).to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        yield told(table.slice(0, cut))
        # a copy, so that the rest of the batch can go
        waiting = table.slice(cut).take(pa.array(np.arange(len(table) - cut)))
    if waiting is not None:
        yield told(waiting)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, n_near, best, best_n) of the words with a neighbour: one character more, less or another.

    ``best`` is the neighbour of largest n, of equal ones the smallest. Words are distinct.
    """
    # names that sort like the words; long ones aren't carried by each of their rotations
    long = stored(
        words.filter(F.length("word") >= SPELT)
        .orderBy("word")
        .withColumn("name", F.format_string("%020d", F.monotonically_increasing_id())),
        "long",
    )
    rotations = _rotations(words)
    some_long = not long.isEmpty()
    if some_long:
        rotations = rotations.unionByName(
            long.mapInArrow(_hashed_rotations, "rotation string, skipped string, name string, n long, first boolean")
        )
    met = (
        rotations.repartitionByRange("rotation")
        .sortWithinPartitions("rotation")
        .mapInArrow(_scan, "name string, near long, best_n long, best string")
    )
    if some_long:
        for column in ("name", "best"):
            spelt = long.select(F.col("name").alias(column), F.col("word").alias("spelt"))
            met = met.join(spelt, column, "left").withColumn(column, F.coalesce("spelt", column)).drop("spelt")
    best = F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("word"))).alias("first")
    return met.groupBy(F.col("name").alias("word")).agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", F.col("first.word").alias("best"), (-F.col("first.down")).alias("best_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word that forms lead to. Each round doubles the way; there are no circles."""
    found = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(found.join(ahead, "root", "left"), "roots")
        if after.filter("further IS NOT NULL").isEmpty():
            return found
        found = after.select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, form, root, n, n_near, form_n): each distinct word with what it may be a variant of.

    ``form`` is the neighbour of largest n, of equal ones the smallest by code points, where that n is at least
    twice the word's; else null, as is ``form_n``. ``root`` follows forms to the last; it is the word itself if it
    has none. ``n_near`` counts neighbours, 0 if there are none. No words give no rows.
    """
    words = stored(words.select("word", "n"), "words")
    near = neighbours(words)
    joined = words.join(near, "word", "left")
    strong = F.col("best_n") >= 2 * F.col("n")
    formed = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
