import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import line_dedup, spelling, whitening
from termloom.llm.line_dedup import Cuckoo, LineStore

POOL = [f"Line number {k} of a common pool é" for k in range(30)] + [
    "short é", "nineteen code point", "twenty code points!!", " \tTwenty Code points!!\r", "é" * 20, "é" * 19, "", "x" * 5000
]


def some_documents(rng, ids):
    return [(i, "\n".join(rng.choice(POOL) for _ in range(rng.randint(0, 12))) if rng.random() > 0.05 else None) for i in ids]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "h", 1) for d in docs], "doc_id long, text string, hi string, n int")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def store(spark, tmp_path):
    return LineStore(spark, f"{tmp_path}/lines")


# --- line dedup ---------------------------------------------------------------------------------


def test_a_cuckoo_filter_forgets_what_is_removed():
    rng = np.random.default_rng(0)
    one = Cuckoo(1 << 10)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, one.room())
    one.add(hashes)
    assert one.contains(hashes).all() and one.used == len(hashes) and one.room() == 0
    others = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    assert one.contains(others).mean() < 0.001
    assert not one.remove(hashes[:2000]).any()
    assert one.contains(hashes[2000:]).all() and one.contains(hashes[:2000]).mean() < 0.01
    one.remove(hashes[2000:])
    assert not one.slots.any()
    # equal hashes are as many prints
    one.add(np.repeat(hashes[:1], 3))
    assert not one.remove(np.repeat(hashes[:1], 2)).any() and one.contains(hashes[:1]).all()
    chain = []
    line_dedup.add_to_chain(chain, hashes, 1 << 6)
    assert len(chain) > 10 and line_dedup.in_chain(chain, hashes).all()
    line_dedup.remove_from_chain(chain, hashes)
    assert not any(c.used for c in chain)


@pytest.mark.parametrize("small", [False, True])
def test_lines_come_back_when_documents_go(spark, store, monkeypatch, small):
    if small:  # many shards, chains of filters and passes
        for name, value in (("KNOWN_BUCKETS", 4), ("REPEATED_BUCKETS", 2), ("SHARD_LINES", 5), ("FILTER_BYTES", 40)):
            monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(3)
    first, second = some_documents(rng, range(25)), some_documents(rng, range(100, 130))
    again = some_documents(rng, [*range(15, 30), 110])
    check = lambda s, docs: rows_of(s.clean(frame(spark, docs), texts=False)) == sorted(brute.without_repeated_lines(docs), key=repr)
    store.insert(frame(spark, first))
    assert check(store, first)
    store.insert(frame(spark, second))
    assert check(store, first + second)
    store = LineStore(spark, store.path)
    store.delete(frame(spark, second).select("doc_id"))
    assert check(store, first)
    store.insert(frame(spark, second))
    store.insert(frame(spark, again))
    assert check(store, list((dict(first) | dict(second) | dict(again)).items()))
    store.delete(frame(spark, first + second + again))
    assert store.totals().isEmpty() and store.drops().isEmpty()
    slots = [bytes(r["slots"]) for r in store.filters().collect()]
    assert slots and not any(any(s) for s in slots)


def test_lines_of_messy_documents(spark, store, rows, messy, empty):
    docs = [(i, t) for i, t, _ in rows]
    lines = "one line that is long enough\nanother line that is long enough\nshort"
    docs += [(500, lines), (501, lines + "\n\n"), (None, lines), (None, lines), (502, lines.upper()), (500, lines + "\nmore"), (503, "\n")]
    store.insert(frame(spark, docs))
    out = store.clean(frame(spark, docs))
    assert rows_of(out.drop("kept")) == sorted(brute.without_repeated_lines(docs), key=repr)
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in out.filter("doc_id > 500").collect()}
    assert kept == {501: "short\n\n", 502: lines.upper(), 503: "\n"}
    assert store.clean(empty).isEmpty()
    assert store.clean(frame(spark, [(999, lines)])).first()["n_dropped"] == 0
    # texts without an id count once, however often they are inserted
    store.insert(frame(spark, [(None, "a line that only the nameless have")] * 2))
    store.insert(frame(spark, [(None, "a line that only the nameless have")]))
    assert store.totals().filter("last.doc_id IS NULL").agg(F.max("n")).first()[0] == 1
    with pytest.raises(ValueError):
        LineStore(spark, store.path, least_documents=2)


def test_an_empty_line_store(spark, store, empty):
    store.delete(empty)
    store.insert(empty)
    assert store.clean(empty).isEmpty() and store.drops().isEmpty()
    docs = [(i, "a line of at least twenty characters") for i in range(4)]
    store.insert(frame(spark, docs))
    assert rows_of(store.clean(frame(spark, docs), texts=False)) == sorted(brute.without_repeated_lines(docs), key=repr)


# --- spelling variants ----------------------------------------------------------------------------


def test_damaged_words_equal_brute_force(spark, rows, messy, empty):
    docs = [(i, t) for i, t, _ in rows]
    docs += [(i, f"Éclair éCLAIR école{i % 7} naïveté ABCDE abcdé " + "wörter" * 30) for i in range(300)]
    got = dict(map(tuple, spelling.damaged_words(frame(spark, docs)).collect()))
    assert got == brute.word_counts(docs) and len(got) > 12
    assert spelling.damaged_words(empty).isEmpty()


def test_variants_equal_brute_force(spark):
    rng = random.Random(1)
    words = {}
    while len(words) < 300:
        words["".join(rng.choice("abé") for _ in range(rng.choice([5, 5, 6, 6, 7])))] = rng.randint(3, 40)
    # around the length from which rotations are hashed, with ties
    for size in (63, 64, 65, 66, 3000):
        base = "".join(rng.choice("ab") for _ in range(size))
        for w in (base, base[:-1] + "c", "c" + base[1:], base + "c", base[:10] + "z" + base[10:], base[1:], base[:5] + base[6:]):
            words[w] = rng.choice([3, 20, 20, 50])
    words |= {"x" * n: 3 * n for n in range(1, 9)} | {"x" * 4 + "y" * n: 7 for n in range(9)}
    table = spark.createDataFrame([(*w, "r") for w in words.items()], "word string, n long, rotation string").repartition(5)
    assert rows_of(spelling.variants(table)) == sorted(brute.variants(words), key=repr)


def test_forms_lead_to_a_root(spark):
    chain = ["abcde" + "x" * k for k in range(12)]
    table = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    assert {r["root"] for r in spelling.variants(table).collect()} == {chain[-1]}
    assert spelling.variants(table.filter("false")).isEmpty()
    alone = spelling.variants(table.filter("n = 3")).collect()
    assert [tuple(r) for r in alone] == [("abcde", None, "abcde", 3, 0, None)]


def test_variants_of_the_tables(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    words = brute.word_counts(docs)
    got = {r["word"]: r for r in spelling.variants(spelling.damaged_words(frame(spark, docs))).collect()}
    assert {w: r["n"] for w, r in got.items()} == words
    some = sorted(words)[::50]
    for w in some:
        near = [(-n, v) for v, n in words.items() if brute.one_edit(w, v)]
        best = min(near, default=(0, None))
        form = best[1] if -best[0] >= 2 * words[w] else None
        assert (got[w]["n_near"], got[w]["form"]) == (len(near), form)
        assert got[w]["root"] == (got[form]["root"] if form else w)


# --- whitening ------------------------------------------------------------------------------------


def checked(spark, vectors, d, count=4):
    """Hold the result against numpy's eigenvectors; returns its rows by id."""
    table = spark.createDataFrame([(i, v, "c", "n") for i, v in vectors], "vec_id long, embedding array<float>, component string, n string")
    got = whitening.whiten(table.repartition(3), count).collect()
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (d - len(v)) for _, v in good]
    fit = np.unique(np.array(x, float), axis=0)
    mean = fit.mean(axis=0)
    covariance = (fit - mean).T @ (fit - mean) / len(fit)
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    keep = min(count, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == keep * len(good)
    n, sums = len(fit), [sum(int(r[k]) for r in fit) for k in range(d)]
    deviations = sorted(sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == deviations
    assert {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-9 for r in got)
    for k in range(keep):
        rows = [r for r in got if r["component"] == k + 1]
        assert all(r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9) for r in rows)
        white = (np.array(x) - mean) @ vectors_[:, k] / math.sqrt(values[k])
        own = np.array([r["whitened"] for r in rows])
        gaps = np.abs(np.delete(values[:keep + 1], k) - values[k])
        if (gaps > 1e-6 * values[0]).all():  # of equal variances any directions do
            assert min(np.abs(np.sort(own) - np.sort(s * white)).max() for s in (1, -1)) < 1e-7
    return got


def test_whitening_equals_numpy(spark, folder):
    rng = np.random.default_rng(4)
    vectors = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((300, 9)) * np.linspace(2, 0.5, 9))]
    vectors += vectors[:50] * 20 + [(None, vectors[3][1]), (7, None), (8, [0.5, None]), (9, [math.nan] * 9), (10, [math.inf, 1.0]), (11, []), (12, [1.5])]
    checked(spark, vectors, 9)
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    checked(spark, [(r["vec_id"], r["embedding"]) for r in table.collect()], 64, 64)


def test_whitening_with_equal_and_missing_variances(spark):
    unit = [(k, [float(s * (j == k % 6)) for j in range(6)]) for k in range(6) for s in (1, -1)]
    assert len(checked(spark, unit, 6)) == 48
    flat = [(k, [k * 0.25, k * 0.5 + (k % 3), 0.0]) for k in range(10)]
    assert {r["component"] for r in checked(spark, flat, 3)} == {1, 2}
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<float>")
    for none in (same, same.filter("false"), same.withColumn("embedding", F.lit(None).cast("array<float>"))):
        assert whitening.whiten(none).isEmpty()


def test_deviations_beyond_a_long(spark):
    big = [(0, [1e15]), (1, [-1e15]), (2, [1e30]), (3, [0.0])]
    table = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in whitening.whiten(table).collect()}
    assert set(got) == {0, 1, 2, 3} and got[2]["deviation"] is None
    x = np.array([[1 << 31], [3]])
    assert whitening._deviations(x, 2, [(1 << 31) + 3]) == [((1 << 31) - 3) ** 2] * 2
    assert whitening._deviations(x, 1 << 31, [0]) == [None, (3 << 31) ** 2 if (3 << 31) ** 2 < 1 << 63 else None]


@pytest.mark.parametrize("kind", ["falling", "multiple", "low rank", "equal"])
def test_bidiagonalisation(kind):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((400, 20))
    if kind == "falling":
        a *= np.logspace(0, -8, 20)
    elif kind == "low rank":
        a = a[:, :2] @ rng.standard_normal((2, 20))
    else:
        a = np.linalg.qr(a)[0] * np.array([5, 5, 5, 3, 3] + [1] * 15 if kind == "multiple" else [2] * 20)
    vectors, values = whitening.bidiagonalise(lambda v: a.T @ (a @ v), 20, float((a * a).sum()), 4)
    true = np.linalg.svd(a)[1][:4]
    assert np.allclose(values[:4], true, rtol=1e-10, atol=1e-7 * true[0])
    assert np.allclose(vectors[:, :4].T @ vectors[:, :4], np.eye(4), atol=1e-12)
    strong = true > 1e-6 * true[0]
    left = a @ vectors[:, :4][:, strong] / true[strong]
    assert np.allclose(left.T @ left, np.eye(strong.sum()), atol=1e-8)
