import random
import re

from plain_porter import _STEP_2, _STEP_3, _STEP_4
from plain_porter import porter_stem as plain_stem

from termloom.functions.porter import porter_stem

# word and stem pairs from the examples of the published algorithm
PAIRS = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster
bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
""".split()


def stems(spark, words):
    frame = spark.createDataFrame([(w,) for w in words], "term string")
    return {r["term"]: r["stem"] for r in frame.select("term", porter_stem("term").alias("stem")).collect()}


def test_published_examples(spark):
    assert stems(spark, PAIRS[::2]) == dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))


def test_short_words_stay(spark):
    assert stems(spark, ["a", "is", "be", "", None]) == {"a": "a", "is": "is", "be": "be", "": "", None: None}


def test_stems_equal_the_plain_version(spark):
    rng = random.Random(1)
    pieces = ["y", "yy", "yyy", "a", "e", "ss", "l", "ll", "t", "é", "b", "w", "x", "zz", "o", "𝒳", "1", "ing", "ed", "eed", "at", "bl", "iz"]
    ends = ["", "s", "es", "ing", "ed", "y", "e", "ll", *_STEP_2, *_STEP_3, *_STEP_4]
    words = {"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) + rng.choice(ends) for _ in range(20_000)}
    got = stems(spark, sorted(words))
    assert {w: (got[w], plain_stem(w)) for w in words if got[w] != plain_stem(w)} == {}


def test_postings_of_stems_travel_as_texts(spark):
    from pyspark.sql import functions as F

    from termloom.operators import analysis

    texts = [("a", "Running, runs ran hopes hoping"), ("b", "hope run-run RUNNING"), ("b", "hoped 7 run runs"), ("b", "x y"), (None, "hoping"), (None, "hopes"), ("c", "")]
    rows = [(path, text, "", ["runs", path]) for path, text in texts]
    corpus = spark.createDataFrame(rows, "path string, content string, title string, tags array<string>").withColumn("filename", F.col("path"))
    found = analysis.analyze(corpus.filter("content IS NOT NULL"), stem=True)
    expected = {}
    for path, text, _, tags in rows:
        contents = [plain_stem(word) for word in re.findall(r"\w+", text.lower())]
        fields = {"content": [plain_stem(w) for w in contents], "filename": [path] if path else [], "tags": [] if None in tags else tags}
        for field, terms in fields.items():
            for place, term in enumerate(terms):
                expected.setdefault((path, field, len(terms), term), []).append(place)
    shown = {(r["path"], r["field"], r["doc_len"], r["term"]): r["positions"] for r in found.collect() if r["term"] is not None and (r["field"] != "tags" or r["path"])}
    assert shown == {key: sorted(places) for key, places in expected.items()}
    assert all(r["tf"] == len(r["positions"]) for r in found.collect() if r["positions"])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan
