import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n string, key string, label string, spans string, score string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeiounst") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def passages():
    rng = random.Random(5)
    return [prose(rng, n) for n in (9, 14, 30, 61, 3)]


@pytest.fixture(scope="session")
def rows(passages):
    """Rows (doc_id, text, lang): nulls, empty and very long texts, ties, copies, near copies and shared passages."""
    rng = random.Random(4)
    base = prose(rng, 120)
    words = base.split()
    texts = [base, base.upper(), base + " end", " ".join([*words[:60], "changed", *words[61:]]), base, base]
    texts += [" ".join(w for w in words if rng.random() > 0.03) for _ in range(6)]
    texts += [prose(rng, 40) + " " + p + " " + prose(rng, 30) for p in passages for _ in range(2)]
    texts += [p.capitalize() for p in passages]
    texts += [None, "", " \n\t ", "one", "one two three four", "One  two\tthree four", "é" * 700, "x" * 3000, "日本語 " * 150, "123 456 --- 789"]
    texts += [prose(rng, 4000), ("lorem ipsum dolor " * 60), "ag" * 900, None]
    out = [(i, t, ["en", "de", None][i % 3] if t else None) for i, t in enumerate(texts)]
    out += [out[0], out[0], (None, base, "en"), (None, None, None), (-7, "one", "en"), (-7, "other text", "de")]
    return out


@pytest.fixture(scope="session")
def messy(spark, rows):
    filled = [(i, t, lang, "src0", len(t or ""), "r", "n", "k", "l", "s", "x") for i, t, lang in rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark, passages):
    rows = [*enumerate(passages), (5, None), (6, ""), (7, passages[1]), (7, passages[1]), (None, "no id")]
    return spark.createDataFrame(rows, "item_id long, text string")
