"""Search of an index that is not stored: terms counted once, pairs added up where their document is."""

from pyspark.sql import functions as F

from termloom.operators import analysis
from termloom.plans import unstored


def test_counted_terms_are_the_postings(spark):
    rows = [("a", "content", ["x", "y", "x"]), ("a", "tags", ["t", None]), ("b", "content", []), ("b", "tags", ["t", "t"])]
    tokens = spark.createDataFrame(rows, "path string, field string, tokens array<string>")
    counted = unstored.Counted(analysis.count_terms(tokens), None).postings()
    inverted = analysis.invert(tokens).select("path", "field", "doc_len", "term", "tf").filter("term IS NOT NULL")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, inverted.collect())) != []


def test_pairs_are_not_shuffled(spark):
    scored = spark.createDataFrame([("a", "content", "x", 1.0), ("a", "content", "y", 2.0)], "path string, field string, term string, part double")
    terms = spark.createDataFrame([(1, "content", "x"), (1, "content", "y"), (2, "content", "y")], "query_id long, field string, term string")
    pairs = unstored.add_up(unstored.by_document(scored, 0), terms, True, None, 0)
    assert sorted(map(tuple, pairs.collect())) == [(1, "a", 3.0), (2, "a", 2.0)]
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_clauses_beyond_one_mask(spark):
    rows = [(1, i, i == 0) for i in range(130)]
    clauses = spark.createDataFrame(rows, "query_id long, clause int, negated boolean")
    columns = unstored.masks(F.col("clause"), F.col("negated"), 130)
    found = clauses.groupBy("query_id").agg(*columns).first()
    assert [bin(found[f"mask{j}"]).count("1") for j in range(3)] == [61, 62, 6]


def corpus_of(spark, texts):
    from termloom.sources import tables

    rows = [(i, text, "en", "s") for i, text in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return tables.as_corpus(tables.documents_as_files(documents), markup=False)


def test_only_wanted_terms_are_counted_and_all_lengths(spark):
    from termloom.operators.index import index_of

    index = index_of(corpus_of(spark, ["running runs now", "run run far away", "nothing here"]), stem=True)
    wanted = spark.createDataFrame([("run",), ("s",)], "term string")
    found = unstored.count(index, wanted, unstored.stems_of(index))
    content = found.postings().filter("field = 'content'").select("path", "doc_len", "term", "tf")
    assert sorted(map(tuple, content.collect())) == [("s/0.txt", 3, "run", 2), ("s/1.txt", 4, "run", 2)]
    assert sorted(map(tuple, found.postings().filter("field = 'tags'").select("term", "tf").collect())) == [("s", 1)] * 3
    expected = {tuple(row) for row in index.field_stats.collect()}
    assert {tuple(row) for row in found.field_stats().collect()} == expected


def test_more_wanted_terms_than_a_broadcast(spark, monkeypatch):
    from termloom.operators.index import index_of

    index = index_of(corpus_of(spark, ["a b a", "b c"]))
    wanted = spark.createDataFrame([("a",), ("b",)], "term string")
    few = unstored.count(index, wanted)
    monkeypatch.setattr(unstored, "BLOCK_ROWS", 1)
    many = unstored.count(index, wanted)
    shown = ["path", "field", "doc_len", "term", "tf"]
    assert sorted(map(repr, many.rows.select(shown).collect())) == sorted(map(repr, few.rows.select(shown).collect())) != []


def test_phrases_and_misspelt_words_are_found_where_documents_are(spark):
    from termloom.operators.index import index_of
    from termloom.options import SearchOptions
    from termloom.plans import search

    index = index_of(corpus_of(spark, ["alpha beta gamma", "beta alpha gamma", "alpha beta beta", "none of them"]))
    texts = [(1, '"alpha beta"'), (2, "gamme"), (3, "alph* none"), (4, "gamma none")]
    queries = spark.createDataFrame(texts, "query_id long, query string")
    found = search.batch_search(index, queries, SearchOptions(highlight=False)).select("query_id", "path").collect()
    hits = {(row["query_id"], int(row["path"][2])) for row in found}
    assert hits == {(1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (3, 3), (4, 0), (4, 1), (4, 3)}


def test_a_word_of_the_query_that_a_cut_leaves_is_marked(spark):
    from termloom.operators.index import index_of
    from termloom.options import SearchOptions
    from termloom.plans import search

    # 200 characters end within the last word, after "long"
    text = "first " + "x" * 189 + " longest"
    queries = spark.createDataFrame([(1, "first long")], "query_id long, query string")
    found = search.batch_search(index_of(corpus_of(spark, ["title\n" + text])), queries, SearchOptions(fuzzy=False)).first()
    assert found["highlights"]["content"].count("<b>") == 1 + found["highlights"]["content"].endswith("<b>long</b>")
    direct = search.with_snippets(
        search._with_own_words(
            spark.createDataFrame([(1, "p", text, "t", ["first"])], "query_id long, path string, content string, title string, matched array<string>"),
            search.analyze_queries(queries, SearchOptions(fuzzy=False)).withColumn("operators", F.lit(False)), SearchOptions(), True,
        )
    ).first()
    assert direct["highlights"]["content"].endswith(" <b>long</b>")


def odd_index(spark):
    from termloom.operators.index import index_of

    texts = ["alpha beta gamma alphabet", "alphas alpha beta beta", "zeta alps beta", "1 2 3", "alpine bet betas alp", "gamma beta alpha beta"]
    corpus = corpus_of(spark, texts)
    # two documents share a path, two have none
    path = F.when(F.col("path").isin("s/1.txt", "s/2.txt"), "s/1.txt").when(F.col("path") < "s/5.txt", F.col("path"))
    nobody = corpus.filter("path = 's/4.txt'").withColumn("path", F.lit(None).cast("string"))
    return index_of(corpus.withColumn("path", F.coalesce(path, F.when(F.col("path") != "s/5.txt", F.col("path")))).unionByName(nobody))


PATTERN_TEXTS = [
    (1, "alp* beta"), (2, "alph* alpha beta"), (3, "alp* alph* bet?"), (4, "*eta gamma content:alpha"), (5, "bet? title:alpha tags:s"),
    (6, "beta* filename:txt"), (7, "zzz*"), (8, "zzz* beta"), (9, "alp*a*"), (10, "beta* beta content:beta"),
    (11, "alphe"), (12, "Beta* AND alpha"),
]


def check_patterns(spark, monkeypatch, **changes):
    from dataclasses import replace

    from termloom.options import SearchOptions
    from termloom.plans import search

    index = odd_index(spark)
    queries = spark.createDataFrame(PATTERN_TEXTS, "query_id long, query string")
    options = SearchOptions(**changes)
    shown = ["query_id", "rank", "path", F.round("score", 6).alias("score"), "highlights.content", "highlights.title"]
    by_query = search.batch_search(replace(index, tokens=None), queries, options).select(shown).collect()

    def refused(*args):
        raise AssertionError("hits of patterns are dealt by query")

    monkeypatch.setattr(search, "_in_postings", refused)
    by_document = search.batch_search(index, queries, options).select(shown).collect()
    assert sorted(map(repr, by_document)) == sorted(map(repr, by_query))
    assert {row["query_id"] for row in by_document} >= {1, 2, 3, 4, 5, 6, 8, 9, 10}


def test_patterns_are_added_up_where_documents_are(spark, monkeypatch):
    check_patterns(spark, monkeypatch)


def test_rare_words_of_patterns_meet_what_they_lead_to_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(unstored, "WORD_ROWS", 3)
    monkeypatch.setattr(unstored, "MANY_PAIRS", 1)
    check_patterns(spark, monkeypatch, limit=2, scorer="tfidf")


def test_no_word_of_patterns_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(unstored, "WORD_ROWS", 0)
    check_patterns(spark, monkeypatch, filter_stage="before_topk", max_size=25)


def test_hits_of_phrases_meet_their_documents_alone(spark):
    hits = [("a", "content", "x", 1.0), ("a", "title", "x", 2.0), ("b", "content", "x", 4.0), (None, "content", "x", 8.0)]
    hits = spark.createDataFrame(hits, "path string, field string, term string, part double")
    found = spark.createDataFrame([("x y", "a"), ("z x", "a"), ("y", "b")], "key string, path string")
    words = spark.createDataFrame([("x y", "x"), ("x y", "y"), ("z x", "x"), ("z x", "z"), ("y", "y")], "key string, term string")
    every = unstored.with_phrases(unstored.by_document(hits, 0), found, words, unstored.tasks(hits, 0))
    added = [("a", "phrase", "x y", 1.0), ("a", "phrase", "z x", 1.0)]
    assert sorted(map(repr, map(tuple, every.collect()))) == sorted(map(repr, [*map(tuple, hits.collect()), *added]))
    # not by key: a hit is not repeated for each phrase with its word to find the documents of the phrase
    joins = [x for x in every._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n") if "Join" in x]
    assert any("ShuffledHashJoin [path" in x for x in joins) and not any("key#" in x and "path#" in x for x in joins)
