"""Search over a small corpus with expected paths, ranks and scores."""

import math

import pytest
from pyspark.sql import functions as F

from termloom import SearchOptions
from termloom.operators import analysis, match, querylog, rank, report, suggest
from termloom.operators.index import index_of
from termloom.plans.search import batch_search, search
from termloom.sources.tables import as_corpus

DOCS = {
    "a/python_basics.txt": "Python basics\nPython is a programming language. Learn Python programming tutorial steps.",
    "a/ml_intro.txt": "Machine learning introduction\nMachine learning builds models from data with algorithms.",
    "b/web_dev.txt": "Web development\nModern web development uses Python and JavaScript for the web.",
    "b/data_science.txt": "Data science\nData science mixes statistics, machines and learning from data.",
    "c/café.md": "# Café\nUn café naïve résumé 你好世界 🌟",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(path, len(t.encode()), i, t) for i, (path, t) in enumerate(DOCS.items())]
    files = spark.createDataFrame(rows, "path string, size long, i long, text string").coalesce(1)
    files = files.withColumn("modified_time", F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 3600)).drop("i")
    corpus = str(tmp_path_factory.mktemp("corpus") / "corpus")
    as_corpus(files).write.parquet(corpus)
    return index_of(spark.read.parquet(corpus))


def paths(index, text, **options):
    return [r.path for r in search(index, text, SearchOptions(highlight=False, **options)).collect()]


def batch(spark, index, texts, **options):
    """Paths in rank order for each query text."""
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    rows = batch_search(index, queries, SearchOptions(highlight=False, **options)).orderBy("query_id", "rank").collect()
    return [[r.path for r in rows if r.query_id == i] for i in range(len(texts))]


def test_relevance(spark, index):
    expected = {
        "python": "a/python_basics.txt", "machine learning": "a/ml_intro.txt", "web development": "b/web_dev.txt",
        "PYTHON programming": "a/python_basics.txt", "café programmes": "c/café.md", "你好世界 x": "c/café.md",
        "C++ programming": "a/python_basics.txt", "machine-learning": "a/ml_intro.txt",
        "python 🐍 tutorial": "a/python_basics.txt", "tutorial 3.9 2023": "a/python_basics.txt",
    }
    assert [found[0] for found in batch(spark, index, list(expected))] == list(expected.values())


def test_no_rows(spark, index):
    assert batch(spark, index, ["", "   ", "\n\t", None, "the of", "x" * 501, '""']) == [[]] * 7


def test_case_does_not_matter(spark, index):
    upper, lower = batch(spark, index, ["PYTHON Web", "python wEB"])
    assert upper == lower and upper


def test_kinds(spark, index):
    both, either, none, program, machine, misspelt, title, name = batch(
        spark, index,
        ['"machine learning"', '"Learn Python programming" "web development"', '"learning machine"', "program*",
         "mach?ne*", "pyhton", "title:web", "filename:ml_intro"],
    )
    assert both == ["a/ml_intro.txt"] and none == []
    assert set(either) == {"b/web_dev.txt", "a/python_basics.txt"}
    assert program == ["a/python_basics.txt"] and set(machine) == {"a/ml_intro.txt", "b/data_science.txt"}
    assert set(misspelt) == {"a/python_basics.txt", "b/web_dev.txt"}
    assert title == ["b/web_dev.txt"] and name == ["a/ml_intro.txt"]


def test_fuzzy_options(index):
    assert paths(index, "pyhton", fuzzy=False) == []
    assert paths(index, "xython") == []
    assert set(paths(index, "xython", fuzzy_prefix=0)) == {"a/python_basics.txt", "b/web_dev.txt"}


def test_filters_sort_and_limit(index):
    everything = paths(index, "python data web learning café")
    assert len(everything) == 5
    assert paths(index, "python data web learning café", file_types=(".md",)) == ["c/café.md"]
    assert paths(index, "python data web learning café", limit=1, file_types=(".txt",)) == []
    assert paths(index, "python data web learning café", limit=1, file_types=(".txt",), filter_stage="before_topk") == [
        next(p for p in everything if p.endswith(".txt"))
    ]
    by_name = paths(index, "python data web learning café", sort_by="filename", descending=False)
    assert [p.split("/")[1] for p in by_name] == sorted(p.split("/")[1] for p in everything)
    assert paths(index, "python data web", modified_after="2024-01-01 03:00:00") == ["b/data_science.txt"]
    assert len(paths(index, "python data web learning", limit=2)) == 2


def test_bm25_value(index):
    row = search(index, "filename:café").first()
    df, n, tf, length, mean = 1, 5, 1, 2, (2 + 2 + 2 + 2 + 2) / 5
    expected = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    assert row.score == pytest.approx(expected, abs=1e-8)


def test_snippets(index):
    row = search(index, "statistics naïve").filter("path = 'b/data_science.txt'").first()
    assert "<b>statistics</b>" in row.content_snippet and row.highlights.title == "Data science"


def test_marks_are_what_matched(spark, index):
    marks = lambda index, text, **o: " ".join(r.highlights.content for r in search(index, text, SearchOptions(**o)).collect())
    assert "<b>Python</b>" in marks(index, "pyhton") and "<b>programming</b>" in marks(index, "prog*ing")
    assert "<b>machines</b>" in marks(index, "mach?nes") and "<b>Machine</b>" not in marks(index, "mach?nes")
    stemmed = marks(index_of(index.corpus, stem=True), "mixing machine")
    assert "<b>mixes</b>" in stemmed and "<b>machines</b>" in stemmed and "<b>Machine</b>" in stemmed
    assert "<b>Machine</b> <b>learning</b>" in marks(index, '"machine learning"')


def test_stemming_finds_other_forms(spark, index):
    stemmed = index_of(index.corpus, stem=True)
    assert set(paths(stemmed, "machines mixing", stem=True, fuzzy=False)) == {"a/ml_intro.txt", "b/data_science.txt"}
    assert paths(stemmed, '"machines learn"', stem=True) == ["a/ml_intro.txt"]
    row = stemmed.postings.filter("field = 'content' AND term = 'machin' AND path = 'a/ml_intro.txt'").first()
    assert (row.tf, list(row.positions)) == (2, [0, 3])


def test_metamorphic(spark, index):
    terms = match.query_terms(spark, {1: ["machine", "learning"]})
    hits = match.lookup(index.postings, terms)
    every = {tuple(r) for r in match.all_of(hits, terms).collect()}
    some = {tuple(r) for r in match.any_of(hits).collect()}
    rows = spark.createDataFrame([(1, 0, "machine", 2), (1, 1, "learning", 2)], "phrase_id long, i int, term string, n_terms int")
    phrase = {(r.phrase_id, r.path) for r in match.phrase_hits(index.postings.filter("field = 'content'"), rows).collect()}
    assert phrase <= every <= some and phrase
    vocabulary = index.term_stats.filter("field = 'content'")
    prefixed = {r.term for r in match.expand_prefix(vocabulary, "pro").collect()}
    wild = {r.term for r in match.expand_wildcards(vocabulary, spark.createDataFrame([("*ro*",)], "pattern string")).collect()}
    assert prefixed <= wild and "programming" in prefixed


def test_phrase_with_a_repeated_word(spark):
    postings = spark.createDataFrame(
        [("d", "the", [0, 1, 3, 4, 5]), ("d", "cat", [2]), ("e", "cat", [0, 4]), ("e", "the", [1, 9])], "path string, term string, positions array<int>"
    )
    phrases = match.phrase_rows(spark, [(1, "the the"), (2, "the cat the"), (3, "cat"), (4, "cat dog"), (5, "the the the")])
    expected = [(1, "d", 0), (1, "d", 3), (1, "d", 4), (2, "d", 1), (3, "d", 2), (3, "e", 0), (3, "e", 4), (5, "d", 3)]
    stats = postings.groupBy("term").agg(F.count("*").alias("df"))
    for known in (None, stats):
        for small in (True, False):
            hits = match.phrase_hits(postings, phrases, small, known)
            assert sorted(map(tuple, hits.collect())) == expected
    plan = match.phrase_hits(postings, phrases, True, stats)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "LeftSemi" in plan  # the starts alone are exploded


def test_wildcards_without_literals(spark):
    vocabulary = spark.createDataFrame([("a",), ("ab",), ("abc",), ("xbc",)], "term string")
    patterns = spark.createDataFrame([("*",), ("??",), ("?b*",), ("*c",)], "pattern string")
    got = {(r.pattern, r.term) for r in match.expand_wildcards(vocabulary, patterns).collect()}
    assert got == {
        ("*", "a"), ("*", "ab"), ("*", "abc"), ("*", "xbc"), ("??", "ab"), ("?b*", "ab"), ("?b*", "abc"), ("?b*", "xbc"),
        ("*c", "abc"), ("*c", "xbc"),
    }
    grams = match.gram_rows(vocabulary).withColumn("gbucket", match.term_bucket(F.col("gram"), 3))
    more = patterns.unionByName(spark.createDataFrame([("abc",), ("x*c",), ("*b*",), ("a*",), ("zz*",), ("abc*",)], "pattern string"))
    stored = {tuple(r) for r in match.expand_stored_wildcards(grams, more, 3).collect()}
    assert stored == {tuple(r) for r in match.expand_wildcards(vocabulary, more).collect()} and got < stored


def test_fuzzy_against_brute_force(spark):
    words = ["a", "ab", "ba", "abc", "acb", "abcd", "bcd", "xbc", "éab", "eab", "aéb", "abé", "zzzz"]

    def near(a, b):
        if a == b:
            return True
        if len(a) == len(b):
            diff = [i for i in range(len(a)) if a[i] != b[i]]
            return len(diff) == 1 or (
                len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]
            )
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    vocabulary = spark.createDataFrame([(w,) for w in words], "term string")
    got = {tuple(r) for r in match.expand_fuzzy(vocabulary, vocabulary.withColumnRenamed("term", "word"), 0).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}
    variants = match.variant_rows(vocabulary).withColumn("vbucket", match.term_bucket(F.col("variant"), 3))
    for prefix in (0, 1, 2):
        stored = match.expand_stored_fuzzy(variants, vocabulary.withColumnRenamed("term", "word"), 3, prefix)
        assert {tuple(r) for r in stored.collect()} == {(a, b) for a, b in got if a[:prefix] == b[:prefix]}


def test_invert_equals_grouping(spark, index):
    arrays = analysis.field_tokens(index.corpus)
    grouped = (
        analysis.explode_tokens(arrays).groupBy("path", "field", "term")
        .agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    )
    inverted = analysis.invert(arrays).select("path", "field", "term", "positions")
    assert inverted.exceptAll(grouped).isEmpty() and grouped.exceptAll(inverted).isEmpty()


def test_top_k_plan_limits_before_the_shuffle(spark, index):
    terms = match.query_terms(spark, {1: ["python"]})
    weighed = rank.weigh_terms(terms, index.term_stats, index.field_stats)
    plan = rank.top_k(rank.score_hits(match.lookup(index.postings, weighed)), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_suggestions(index):
    assert [r.suggestion for r in suggest.suggestions(index.term_stats, "Pro").collect()] == ["programming"]
    assert suggest.suggestions(index.term_stats, "  ").collect() == []


def test_reports(spark, index):
    queries = spark.createDataFrame([(1, "python"), (2, "zzzzz"), (3, "machine learning")], "query_id long, query string")
    results = batch_search(index, queries, SearchOptions(fuzzy=False))
    texts = {r.query_id: r.response for r in report.render(queries, results).collect()}
    assert texts[2] == "# No Results Found\n\nSorry, no documents were found matching **'zzzzz'**.\n"
    assert texts[1].startswith("# 2 Documents Found\n\nFound 2 documents matching **'python'**:\n\n## 1. Python basics\n**File:** `python_basics.txt`")
    summaries = {r.query_id: r.summary for r in report.summary_lines(queries, results, 1.234).collect()}
    assert summaries[1] == "Found 2 documents for 'python' in 1.23s. Top file types: 2 .txt"
    assert summaries[2] == "No results found for 'zzzzz' in 1.23s"
    records = {r.query_id: r.total_results for r in querylog.search_records(queries, results, 0.1, {"limit": 20}).collect()}
    assert records == {1: 2, 2: 0, 3: 2}


def test_query_log(spark, tmp_path, index):
    queries = spark.createDataFrame([(1, "python")], "query_id long, query string")
    records = querylog.search_records(queries, batch_search(index, queries), 0.5, {"limit": 20})
    querylog.append_log(records, str(tmp_path / "log"))
    querylog.append_log(records, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    stats = querylog.search_stats(log).first()
    assert (stats.total_searches, stats.average_search_time, stats.average_results_per_search) == (2, 0.5, 2.0)
    assert querylog.recent_queries(log).first().recent_queries == ["python", "python"]
    assert querylog.search_stats(log.limit(0)).collect() == []


def test_boolean_texts(spark, index):
    texts = [
        "python AND machine learning", "web OR mobile development", "NOT deprecated features",
        "python AND (web OR data)", "machine learning NOT neural networks",
    ]
    assert [sorted(found) for found in batch(spark, index, texts)] == [
        [], ["b/web_dev.txt"], [], ["b/web_dev.txt"], [],
    ]
    more = ["python NOT web", "learning NOT (machine OR steps)", "learning AND python", "tutorial OR statistics", "python and web"]
    assert [sorted(found) for found in batch(spark, index, more)] == [
        ["a/python_basics.txt"], ["b/data_science.txt"], [], ["a/python_basics.txt", "b/data_science.txt"],
        ["a/python_basics.txt", "b/web_dev.txt"],
    ]
    assert batch(spark, index, ["NOT python", "a OR b", "NOT"]) == [[]] * 3


def test_stem_comes_from_the_index(index):
    stemmed = index_of(index.corpus, stem=True)
    assert paths(stemmed, "machines mixing", fuzzy=False) == paths(stemmed, "machines mixing", fuzzy=False, stem=True) != []
