"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Texts are read as letters in lower case with one blank for everything between them. Each language has a model of
order ``ORDER``: raw counts for the longest n-grams, counts of different left neighbours for shorter ones, an
absolute discount at each level. A level is one sorted array of hashes of the n-grams that any language has, with
the interpolated log probability of each language beside it, and one of contexts with their back-off weights. The
language with the lowest cross-entropy by character wins. Texts whose cross-entropy is beyond what the language's
calibration documents show, for their length, are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.hashes import SortedHashes
from termloom.llm.words import mix, slices

ORDER = 4
DISCOUNT = 0.75
#: Documents of each language that are learned from, about; a fifth of them calibrates.
SAMPLE = 1_000
UNKNOWN = "und"
#: Characters from which a text counts as long in the calibration, and how far its bounds are widened.
LONG, MARGIN = 500, 1.25
#: The score is the probability that so many characters give, so that long texts don't all score 1.
SCORED = 40

_U = np.uint64
_PLACE = mix(np.arange(101, 101 + ORDER, dtype=_U)) | _U(1)
_BLANK = np.uint32(0x20)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and whether it is a letter, for every code point."""
    low = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i], low[i] = True, ord(c.lower()[0])
    return low, letter


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, each led by ORDER - 1 blanks; where each text begins; its letters."""
    low, letter = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letters = letter[points]
    before = np.empty_like(letters)
    before[:1] = False
    before[1:] = letters[:-1]
    before[begins[:-1][begins[:-1] < len(points)]] = False
    keep = letters | before
    kept = np.where(letters, low[points], _BLANK)[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[begins]
    counts = np.concatenate([[0], np.cumsum(letters)])[begins]
    padded = np.insert(kept, np.repeat(at[:-1], ORDER - 1), _BLANK)
    return padded, at + (ORDER - 1) * np.arange(len(at)), np.diff(counts)


def _hashes(characters: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams that end at characters ORDER - 1, ORDER, …"""
    n = len(characters) - ORDER + 1
    total = np.full(n, _U(size))
    for j in range(size):
        total += characters[ORDER - 1 - j : ORDER - 1 - j + n].astype(_U) * _PLACE[j]
    return mix(total)


class Model:
    """Models of several languages, learned from counts of their n-grams of order ORDER."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``counts``: language -> (n-grams as rows of ORDER characters, how often each occurs)."""
        self.languages = sorted(counts)
        self.bounds = {language: (np.inf, 0.0, 0.0) for language in self.languages}
        alphabet = len({c for grams, _ in counts.values() for c in np.unique(grams)}) + 1
        self.floor = np.log(1.0 / alphabet)
        parts = []
        for language in self.languages:
            grams, times = counts[language]
            own = {}
            for size in range(ORDER, 0, -1):
                if size < ORDER:
                    # how many different characters stand before it
                    grams, times = np.unique(grams[:, 1:], axis=0, return_counts=True)
                contexts, of = np.unique(grams[:, :-1], axis=0, return_inverse=True)
                of = of.reshape(-1)
                total = np.bincount(of, times, len(contexts))
                weight = DISCOUNT * np.bincount(of, minlength=len(contexts)) / total
                own[size] = (
                    dict(zip(map(tuple, grams.tolist()), (np.maximum(times - DISCOUNT, 0) / total[of]).tolist(), strict=True)),
                    dict(zip(map(tuple, contexts.tolist()), weight.tolist(), strict=True)),
                )
            parts.append(own)
        self.levels, self.contexts = [None], [None]
        below: list[dict[tuple, float]] = [{(): 1.0 / alphabet} for _ in parts]
        for size in range(1, ORDER + 1):
            grams = sorted({g for own in parts for g in own[size][0]})
            contexts = sorted({c for own in parts for c in own[size][1]})
            table, weights = np.zeros((len(grams), len(parts))), np.ones((len(contexts), len(parts)))
            for k, own in enumerate(parts):
                seen, weight = own[size]
                values = []
                for g in grams:
                    lower = below[k][g[1:] if size > 1 else ()]
                    values.append(seen.get(g, 0.0) + weight.get(g[:-1], 1.0) * lower)
                table[:, k] = values
                weights[:, k] = [weight.get(c, 1.0) for c in contexts]
                below[k] = dict(zip(grams, values, strict=True))
            self.levels.append(SortedHashes(self._keys(grams, size), np.log(table)))
            self.contexts.append(SortedHashes(self._keys(contexts, size - 1), np.log(weights)))

    @staticmethod
    def _keys(grams: list[tuple], size: int) -> np.ndarray:
        """Hashes as in :func:`_hashes`, the last character first."""
        total = np.full(len(grams), _U(size))
        if size:
            rows = np.array(grams, dtype=_U).reshape(-1, size)
            for j in range(size):
                total += rows[:, size - 1 - j] * _PLACE[j]
        return mix(total)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of each text by language (nats a character), its folded characters, its letters."""
        characters, begins, letters = _characters(data, offsets)
        sizes = np.diff(begins) - (ORDER - 1)
        # n-grams that end in the blanks before a text are no events
        ends = np.ones(len(characters), bool)
        for j in range(ORDER - 1):
            ends[begins[:-1] + j] = False
        at = np.flatnonzero(ends[ORDER - 1 :]) if len(characters) >= ORDER else np.zeros(0, np.int64)
        logs = np.zeros((len(at), len(self.languages)))
        todo = np.arange(len(at))
        for size in range(ORDER, 0, -1):
            if len(todo) == 0:
                break
            keys = _hashes(characters, size)[at[todo]]
            rows = self.levels[size].find(keys)
            logs[todo[rows >= 0]] += self.levels[size].values[rows[rows >= 0]]
            todo = todo[rows < 0]
            if len(todo):
                # the context is what stands before the last character
                before = _hashes(characters, size - 1)[at[todo] - 1] if size > 1 else self._keys([()] * len(todo), 0)
                rows = self.contexts[size].find(before)
                logs[todo[rows >= 0]] += self.contexts[size].values[rows[rows >= 0]]
        logs[todo] += self.floor
        summed = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return -(summed[edges[1:]] - summed[edges[:-1]]) / np.maximum(sizes, 1)[:, None], sizes, letters

    def calibrate(self, shown: dict[str, list[tuple[float, float, int]]]) -> None:
        """Bounds from (cross-entropy, that of the nearest other language, characters) of known documents.

        The bound lies halfway to what texts of other languages show, or beyond every document shown; it is
        wider for short texts, as much as any language's documents ask for.
        """
        widest = 2.0
        for language, rows in shown.items():
            values, others, sizes = (np.array(c) for c in zip(*rows, strict=True))
            mean = float(np.median(values))
            foreign = min(float(np.median(others)), -float(self.floor))
            long = values[sizes >= LONG] - mean
            far = max(MARGIN * float(long.max(initial=0.0)), (foreign - mean) / 2)
            widest = max(widest, MARGIN * float(((values - mean - far) * np.sqrt(sizes)).max()))
            self.bounds[language] = mean, far, 0.0
        self.bounds = {language: (mean, far, widest) for language, (mean, far, _) in self.bounds.items()}

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.languages:
            yield from ((UNKNOWN, 0.0, 0.0, True) for _ in range(len(offsets) - 1))
            return
        entropies, sizes, letters = self.entropies(data, offsets)
        for row, size, some in zip(entropies, sizes.tolist(), letters.tolist(), strict=True):
            if not some:
                yield UNKNOWN, 0.0, 0.0, True
                continue
            best = int(row.argmin())
            score = 1.0 / float(np.exp((row[best] - row) * min(size, SCORED)).sum())
            mean, far, short = self.bounds[self.languages[best]]
            yield self.languages[best], score, float(row[best]), bool(row[best] > mean + far + short / np.sqrt(size))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, n-gram, count), added up in the task's batches."""
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for first, last, data, offsets in slices(batch.column("text")):
            characters, begins, _ = _characters(data, offsets)
            for k in range(last - first):
                own = characters[begins[k] : begins[k + 1]]
                if len(own) < ORDER:
                    continue
                rows, counts = np.unique(np.lib.stride_tricks.sliding_window_view(own, ORDER), axis=0, return_counts=True)
                grams = ["".join(map(chr, row)) for row in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([languages[first + k]] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"]
                )


def _measure(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, cross-entropy in this language, in the nearest other, characters) of texts with letters."""
    known = model.value.languages
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for first, _, data, offsets in slices(batch.column("text")):
            entropies, sizes, letters = model.value.entropies(data, offsets)
            rows = []
            for k in np.flatnonzero(letters):
                if (language := languages[first + k]) in known:
                    own = known.index(language)
                    other = np.delete(entropies[k], own).min(initial=np.inf)
                    rows.append((language, float(entropies[k, own]), float(other), int(sizes[k])))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["lang", "entropy", "other", "n"]
            )


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` documents of each language, chosen by a hash of their id.

    Rows without text, language or id are not learned from. No rows give a model that rejects everything.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("id")).dropna()
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    scale = 1_000_000
    drawn = F.lit(False)
    for language, n in sizes.items():
        bound = -(-scale * sample // n)
        drawn = drawn | ((F.col("lang") == language) & (F.pmod(F.xxhash64("id"), F.lit(scale)) < bound))
    rows = rows.filter(drawn)
    calibrates = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(5)) == 0
    counts = (
        rows.filter(~calibrates).select("lang", "text").mapInArrow(_count, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    by_language = {}
    for language, part in counts.groupby("lang"):
        part = part.sort_values("gram")
        grams = np.array([[ord(c) for c in g] for g in part["gram"]], np.int64)
        by_language[language] = grams, part["n"].to_numpy(np.float64)
    model = Model(by_language)
    measured = rows.filter(calibrates).select("lang", "text").mapInArrow(
        partial(_measure, model=spark.sparkContext.broadcast(model)), "lang string, entropy double, other double, n long"
    )
    shown: dict[str, list[tuple[float, float, int]]] = {}
    for r in measured.collect():
        shown.setdefault(r["lang"], []).append((r["entropy"], r["other"], r["n"]))
    model.calibrate(shown)
    return model


def _identify(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
    for batch in batches:
        rows = [r for _, _, data, offsets in slices(batch.column("_text")) for r in model.value.decide(data, offsets)]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        rest = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), *columns], names=[*rest, "lang_pred", "score", "entropy", "rejected"]
        )


def identify(documents: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with (lang_pred, score, entropy, rejected) of the whole texts, one row for each row.

    A text that is null or has no letter is ``und`` with score 0, and rejected. Ties go to the first language by
    name. Repeated rows get equal results; columns that aren't kept are ignored; no documents give no rows.
    """
    rows = documents.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(
        partial(_identify, model=shared), f"{kinds}, lang_pred string, score double, entropy double, rejected boolean"
    )


def _accepted(batches: Iterator[pa.RecordBatch], model, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rejected = [r[3] for _, _, data, offsets in slices(batch.column(text)) for r in model.value.decide(data, offsets)]
        yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))


def accepted(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that :func:`identify` doesn't reject, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(partial(_accepted, model=shared, text=text), documents.schema)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify_held_out(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), learned from the documents that aren't held out."""
    model = train(documents.filter(~held_out(F.col("doc_id"))))
    found = identify(documents, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
