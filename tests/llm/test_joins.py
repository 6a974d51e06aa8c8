from collections import Counter

import brute
import pytest

from termloom.llm import decontaminate, ngram_join, repeats
from termloom.llm.components import components


def test_near_duplicates_equal_brute_force(rows, messy):
    sets, label = brute.components([t for _, t, _ in rows])
    smallest = {}
    for (i, _, _), s, c in zip(rows, sets, label):
        if s and i is not None:
            smallest[c] = min(i, smallest.get(c, i))
    expected = Counter((i, len(s), smallest.get(c) if s else i) for (i, _, _), s, c in zip(rows, sets, label))
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(messy).collect())
    assert got == expected
    assert len({c for _, _, c in got}) < len(got)


@pytest.mark.parametrize("wide", [2, 128])
def test_wide_columns_lose_no_link(spark, monkeypatch, wide):
    # many near copies of one text, not all of them alike, and a passage that other texts share
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if (i * 7 + k) % 53 else f"x{k}" for i, w in enumerate(base)) for k in range(50)]
    texts += [" ".join([*base[:20], *(f"y{k}-{i}" for i in range(k))]) for k in range(40)]
    sets, label = brute.components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: label.index(c) for i, c in enumerate(label)}


def test_distinct_documents_keep_one_of_each_component(rows, messy):
    sets, label = brute.components([t for _, t, _ in rows])
    kept = ngram_join.distinct_documents(messy)
    assert kept.columns == messy.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    expected, groups = Counter((i, t) for (i, t, _), s in zip(rows, sets) if not s), {}
    for (i, t, _), s, c in zip(rows, sets, label):
        if s:
            groups.setdefault(c, []).append((i is None, i or 0, t))
    # texts of one id that are alike are tied: either may stay
    assert sum(got.values()) == sum(expected.values()) + len(groups)
    for members in groups.values():
        lowest = min(members)[:2]
        assert sum(got[None if m[0] else m[1], m[2]] for m in {m for m in members if m[:2] == lowest}) == 1


def test_empty_tables_join_to_nothing(empty, items):
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.distinct_documents(empty).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.decontaminate(empty, items).columns == empty.columns
    assert repeats.remove_repeats(empty).count() == 0


def test_components_of_chains_and_nulls(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_contaminated_equal_brute_force(rows, passages, messy, items):
    known = [*enumerate(passages), (7, passages[1])]
    expected = Counter((rows[i][0], item, s) for (i, item), s in brute.matches([t for _, t, _ in rows], known).items())
    got = decontaminate.contaminated(messy, items).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got) == expected
    assert expected


def test_contamination_is_found_for_long_items_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 2)
    texts = [" ".join(f"a{i * k}" for i in range(400)) for k in range(1, 6)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(i, i) for i in range(5)}


def test_decontaminate_keeps_clean_documents(rows, passages, messy, items):
    bad = {i for i, _ in brute.matches([t for _, t, _ in rows], list(enumerate(passages)))}
    kept = decontaminate.decontaminate(messy, items)
    assert kept.columns == messy.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(
        (i, t) for k, (i, t, _) in enumerate(rows) if k not in bad
    )
    none = items.filter("false")
    assert decontaminate.decontaminate(messy, none).count() == len(rows)


def test_hamming_blocks_miss_nothing_within_the_radius():
    import numpy as np

    grams = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    size = decontaminate._Size([(0, grams)])
    rng = np.random.default_rng(1)
    prints = []
    for bits in range(decontaminate.RADIUS + 3):
        for _ in range(30):
            value = size.prints[0]
            for b in rng.choice(64, bits, replace=False):
                value ^= 1 << int(b)
            prints.append(value)
    found = [set(at.tolist()) for _, at in size.candidates(np.array(prints, np.uint64))][0]
    assert found == set(range(30 * (decontaminate.RADIUS + 1)))


def test_removed_repeats_equal_brute_force(rows, messy):
    import hashlib

    expected = Counter(
        (i, n, gone, runs, hashlib.sha256(kept).hexdigest(), kept)
        for (i, _, _), (n, gone, runs, kept) in zip(rows, brute.without_repeats([t for _, t, _ in rows]))
    )
    got = repeats.remove_repeats(messy).collect()
    assert Counter((*tuple(r)[:5], bytes(r["kept"])) for r in got) == expected
    assert sum(r["n_removed"] for r in got) > 1000


def test_repeats_in_long_texts_cross_pieces(spark, monkeypatch):
    import random

    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = random.Random(3)
    part = "".join(rng.choice("abcdef \n") for _ in range(950))
    texts = ["".join(rng.choice("ghijkl ") for _ in range(n)) + part + "".join(rng.choice("mnop ") for _ in range(n)) for n in (777, 1403, 10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    # in this process, so that the smaller pieces hold
    frame = docs.toArrow().to_batches()[0]
    assert max(len(data) for _, _, data in repeats._pieces(frame.column("text"))) <= 1000 + repeats.LENGTH
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == {i: x[:3] for i, x in enumerate(brute.without_repeats(texts))}
