"""Files to stored index: scans, incremental runs, replacement, deletion, compaction, streaming."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from termloom import IngestOptions, SearchOptions
from termloom.operators import match
from termloom.operators.index import index_of
from termloom.plans.indexing import file_documents, file_status, index_documents, index_stats, index_table, reindex
from termloom.plans.search import batch_search, search
from termloom.sources.files import list_mounted, read_mounted, scan_files, with_names
from termloom.sources.store import IndexStore
from termloom.sources.tables import as_corpus, documents_as_files
from termloom.streaming.ingest import ingest_stream

OPTIONS = IngestOptions(buckets=4)
FILES = {
    "doc1.txt": "Python programming tutorial", "doc2.txt": "Machine learning algorithms", "doc3.txt": "Data science methods",
    "doc4.md": "# Web Development\nBuilding modern web applications", "readme.README": "unsupported", "binary.bin": bytes(range(6)),
    "empty.txt": "", "blank.txt": "   \n\t  \n  ", ".hidden.txt": "hidden words", "cache.pyc": "compiled", "UPPER.TXT": "upper suffix",
    "unicode.txt": "你好世界 🌟 café naïve résumé", "special.txt": "!@#$%^&*()_+-=[]{}|;:',.<>?/~`", "bad.txt": b"ab\xffc broken",
    "level1/a.txt": "nested one", "level1/level2/b.html": "<p>nested two</p><script>x</script>", "large.txt": "This is a test sentence. " * 10_000,
}


def found(spark, root, text, **options):
    return [r.path.rsplit("/", 1)[1] for r in search(IndexStore(spark, root).index(), text, SearchOptions(**options)).collect()]


def as_rows(index):
    terms = {tuple(r) for r in index.term_stats.select("field", "term", "df", "cf").collect()}
    fields = {(r.field, r.n_docs, round(r.avg_len, 9)) for r in index.field_stats.collect() if r.avg_len}
    postings = {(r.path, r.field, r.term, r.tf, r.doc_len, tuple(r.positions)) for r in index.postings.select("path", "field", "term", "tf", "doc_len", "positions").collect()}
    return terms, fields, postings


def test_folder(spark, write, tmp_path):
    docs, root = write(FILES), str(tmp_path / "index")
    run = index_documents(spark, docs, root, OPTIONS)
    status = {r.path.rsplit("/", 1)[1]: (r.status, r.reason) for r in run.status.collect()}
    assert status["doc1.txt"] == ("indexed", None) and status["bad.txt"] == ("indexed", None)
    assert status["b.html"] == ("indexed", None) and status["UPPER.TXT"] == ("indexed", None)
    assert status["readme.README"] == ("skipped", "unsupported") and status["cache.pyc"] == ("skipped", "excluded")
    assert status["blank.txt"] == ("skipped", "empty") and "empty.txt" not in status  # the file source hides it
    assert tuple(run.report.first())[1:] == (11, len(status) - 11, 0)
    stats = index_stats(spark, root).first()
    assert stats.document_count == 11 and "content_hash" in stats.field_names
    assert set(found(spark, root, "nested words")) == {"a.txt", "b.html"}
    assert found(spark, root, "broken pieces") == ["bad.txt"]
    row = IndexStore(spark, root).corpus().filter("filename = 'large.txt'").first()
    assert (row.size, row.word_count, row.metadata.char_count) == (250_000, 60_000, 250_000)


def test_not_recursive_single_and_missing(spark, write, tmp_path):
    docs = write(FILES)
    names = {r.filename for r in scan_files(spark, docs, recursive=False).collect()}
    assert "doc1.txt" in names and "a.txt" not in names
    run = index_documents(spark, docs + "/doc1.txt", str(tmp_path / "one"), OPTIONS)
    assert run.report.first().indexed_files == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index_documents(spark, docs + "/nowhere", str(tmp_path / "none"), OPTIONS)


def test_empty_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    run = index_documents(spark, str(tmp_path / "docs"), str(tmp_path / "index"), OPTIONS, mounted=True)
    assert tuple(run.report.first()) == (0, 0, 0, 0)


def test_mounted_lists_all_names(spark, write, tmp_path):
    docs = write({"__init__.py": "import numbers", "_x/y.txt": "below an underscore", ".h.txt": "hidden", "a.txt": "plain", "empty.txt": ""})
    assert {r.filename for r in list_mounted(spark, docs).collect()} == {"__init__.py", "y.txt", ".h.txt", "a.txt", "empty.txt"}
    run = index_documents(spark, docs, str(tmp_path / "index"), OPTIONS, mounted=True)
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in run.status.collect()} == {
        "__init__.py": None, "y.txt": None, "a.txt": None, ".h.txt": "hidden", "empty.txt": "empty",
    }
    listed = list_mounted(spark, docs)
    gone = listed.withColumn("path", F.when(F.col("filename") == "a.txt", "/nowhere").otherwise(F.col("path")))
    assert {(r.path == "/nowhere", r.error) for r in read_mounted(gone).collect()} == {(True, "No such file or directory"), (False, None)}
    # a tree of several levels, each folder listed once
    write({f"d{i}/e{j}/f/g{k}.txt": f"deep words {i}{j}{k}" for i in range(3) for j in range(3) for k in range(2)})
    assert list_mounted(spark, docs).count() == 5 + 18 and list_mounted(spark, docs, recursive=False).count() == 4
    run = reindex(spark, docs, str(tmp_path / "index"), OPTIONS, mounted=True)
    assert run.report.first().indexed_files == 18 and set(found(spark, str(tmp_path / "index"), "deep")) == {"g0.txt", "g1.txt"}


def test_incremental_run(spark, write, tmp_path):
    docs, root = write({"a.txt": "first apple", "b.txt": "second banana", "c.txt": "third cherry"}), str(tmp_path / "index")
    index_documents(spark, docs, root, OPTIONS)
    again = reindex(spark, docs, root, OPTIONS)
    assert {r.reason for r in again.status.collect()} == {"up_to_date"} and again.report.first().skipped_files == 3
    path = os.path.join(docs, "b.txt")
    with open(path, "w") as file:
        file.write("renewed blueberry")
    later = os.stat(path).st_mtime + 100
    os.utime(path, (later, later))
    os.remove(os.path.join(docs, "c.txt"))
    run = index_documents(spark, docs, root, OPTIONS)
    assert {(r.path[-5:], r.status) for r in run.status.collect()} == {("a.txt", "skipped"), ("b.txt", "indexed")}
    assert found(spark, root, "banana", fuzzy=False) == [] and found(spark, root, "blueberry") == ["b.txt"]
    assert found(spark, root, "cherry") == ["c.txt"]  # a removed file stays unless it is asked for
    reindex(spark, docs, root, OPTIONS, delete_missing=True)
    assert found(spark, root, "cherry") == []
    assert IndexStore(spark, root).state.n_docs == 2


@pytest.fixture(scope="module")
def corpora(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    old = as_corpus(documents_as_files(documents.filter("lang <> 'fr'")), markup=False)
    changed = documents.filter("lang in ('de', 'fr')").withColumn("text", F.concat("text", F.lit(" changed words")))
    new = as_corpus(documents_as_files(changed), markup=False).withColumn("modified_time", F.expr("modified_time + INTERVAL 1 DAY"))
    return old, new


@pytest.mark.parametrize("stem", [False, True])
def test_batches_equal_one_index(spark, tmp_path, corpora, stem):
    old, new = corpora
    root = str(tmp_path / "index")
    index_table(old, root, buckets=4, stem=stem, unique_paths=True)
    index_table(new.unionByName(new.withColumn("modified_time", F.expr("modified_time - INTERVAL 2 DAY"))), root)
    index_table(new, root)  # the same again changes nothing
    merged = index_of(old.join(new.select("path"), "path", "left_anti").unionByName(new), stem)
    expected = as_rows(merged)
    store = IndexStore(spark, root)
    assert as_rows(store.index()) == expected
    store.compact()
    store = IndexStore(spark, root)
    assert store.state.batches == [3] and as_rows(store.index()) == expected
    assert store.corpus().count() == merged.corpus.count()


def test_stored_search_equals_derived_search(spark, tmp_path, corpora):
    old, _ = corpora
    root = str(tmp_path / "index")
    index_table(old, root, buckets=4, unique_paths=True)
    rows = [(1, '"of the"'), (2, "thtion*"), (3, "thtion"), (4, "filename:12 that"), (5, "heed with erthen"), (6, "tags:en")]
    queries = spark.createDataFrame(rows, "query_id long, query string")
    columns = ["query_id", "rank", "path", "score", "content_snippet"]
    stored = batch_search(IndexStore(spark, root).index(), queries).select(columns).collect()
    derived = batch_search(index_of(old), queries).select(columns).collect()
    assert sorted(stored) == sorted(derived) and {r.query_id for r in stored} == {1, 2, 3, 4, 5, 6}


def test_lookup_prunes_buckets(spark, tmp_path, corpora):
    root = str(tmp_path / "index")
    index_table(corpora[0], root, buckets=4, unique_paths=True)
    frame = search(IndexStore(spark, root).index(), "heed with")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_frequent_terms_get_several_tasks(spark, tmp_path):
    rows = [(f"d/{i}.txt", 10, f"common w{i} x{i}") for i in range(400)]
    files = spark.createDataFrame(rows, "path string, size long, text string").withColumn("modified_time", F.current_timestamp())
    root = str(tmp_path / "index")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        index_table(as_corpus(files.repartition(8), markup=False), root, buckets=4, unique_paths=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    index = IndexStore(spark, root).index()
    rows = index.postings.filter("field = 'content' AND term = 'common'")
    assert rows.count() == 400 and rows.select(F.input_file_name()).distinct().count() > 1
    assert index.term_stats.filter("field = 'content' AND term = 'common'").first().df == 400


def test_small_batches_are_folded(spark, tmp_path, monkeypatch):
    from termloom.sources import store as module

    monkeypatch.setattr(module, "FOLD", 3)
    root = str(tmp_path / "index")
    versions = {}

    def put(i, text, day):
        versions[f"d/{i}.txt"] = (text, day)
        files = spark.createDataFrame([(f"d/{i}.txt", len(text), text)], "path string, size long, text string")
        files = files.withColumn("modified_time", F.to_timestamp(F.lit(f"2024-01-{day:02d}")))
        index_table(as_corpus(files, markup=False).coalesce(1), root, buckets=2)

    for day, i in enumerate([0, 1, 2, 1, 3, 4, 0, 5, 6], 1):
        put(i, f"common words number{i} day{day}", day)
    store = IndexStore(spark, root)
    assert len(store.state.batches) <= 4 and store.state.n_docs == 7
    rows = [(p, len(t), t, d) for p, (t, d) in versions.items()]
    files = spark.createDataFrame(rows, "path string, size long, text string, d int")
    files = files.withColumn("modified_time", F.expr("make_timestamp(2024, 1, d, 0, 0, 0)")).drop("d")
    expected = as_rows(index_of(as_corpus(files, markup=False)))
    assert as_rows(store.index()) == expected
    assert set(found(spark, root, "numbr5")) == {"5.txt"} and set(found(spark, root, "day*")) == {f"{i}.txt" for i in range(7)}
    store.compact(buckets=5)
    store = IndexStore(spark, root)
    assert store.state.buckets == 5 and as_rows(store.index()) == expected and found(spark, root, "n?mber6") == ["6.txt"]
    store.compact(rebucket=True)
    assert IndexStore(spark, root).state.buckets == 1 and as_rows(IndexStore(spark, root).index()) == expected


def test_texts_are_shuffled_once(spark, tmp_path, corpora):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=4)
    plan = store.placed(corpora[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == plan.count("Exchange hashpartitioning")


def test_expansions_read_stored_tables(spark, tmp_path, corpora):
    root = str(tmp_path / "index")
    index_table(corpora[0], root, buckets=4, unique_paths=True)
    index = IndexStore(spark, root).index()
    vocabulary = index.term_stats.filter("field = 'content'")
    patterns = spark.createDataFrame([("thtion*",), ("th?t",), ("?n",), ("*ement",), ("*e*",), ("zz*",)], "pattern string")
    wild = match.expand_stored_wildcards(index.grams, patterns, index.buckets)
    assert {tuple(r) for r in wild.collect()} == {tuple(r) for r in match.expand_wildcards(vocabulary, patterns).collect()}
    words = spark.createDataFrame([("taht",), ("thtion",), ("heed",)], "word string")
    fuzzy = match.expand_stored_fuzzy(index.variants, words, index.buckets, 1)
    assert {tuple(r) for r in fuzzy.collect()} == {tuple(r) for r in match.expand_fuzzy(vocabulary, words, 1).collect()}
    plan = fuzzy._jdf.queryExecution().executedPlan().toString()
    # only the buckets and the row groups of the words' own variants
    assert "Generate" not in plan and "PartitionFilters: [vbucket" in plan and "PushedFilters: [In(variant" in plan


def test_stream(spark, write, tmp_path):
    landing = write({"a.txt": "first apple", "b.md": "# Second\nbanana"}, "landing")
    root, checkpoint = str(tmp_path / "index"), str(tmp_path / "checkpoint")
    ingest_stream(spark, landing, root, checkpoint, OPTIONS).awaitTermination()
    assert found(spark, root, "apple") == ["a.txt"] and found(spark, root, "banana") == ["b.md"]
    write({"c.txt": "third cherry"}, "landing")
    os.utime(os.path.join(landing, "c.txt"))
    shutil.copy(os.path.join(landing, "c.txt"), os.path.join(landing, "d.txt"))
    ingest_stream(spark, landing, root, checkpoint, OPTIONS, max_files=1).awaitTermination()
    assert set(found(spark, root, "cherry")) == {"c.txt", "d.txt"} and found(spark, root, "apple") == ["a.txt"]
    store = IndexStore(spark, root)
    assert store.state.n_docs == 4 and store.state.epochs == {checkpoint: 2}
    assert store.ingest(store.corpus().drop("batch", "pbucket"), epoch=(checkpoint, 2)) is None  # a repeated epoch
    rows = [(r.path.rsplit("/", 1)[1], r.status, r.reason, r.batch) for r in store.status().collect()]
    assert {(*r[:3],) for r in rows} >= {("a.txt", "indexed", None), ("c.txt", "indexed", None)}
    # an epoch that ended before it was committed runs again: its files are told once
    store.state.epochs[checkpoint] -= 1
    write({"e.txt": "fifth fig", "f.bin": "no", "g.txt": "  \n"}, "landing")
    files = with_names(scan_files(spark, landing).filter("path RLIKE '[efg][.]'").drop("filename", "extension"))
    outcome = lambda stored: file_status(files.drop("raw"), lambda s: s.select("path", F.lit("x").alias("error")).limit(0), None, OPTIONS, stored)
    for _ in range(2):
        again = IndexStore(spark, root)
        write_state, again._write_state = again._write_state, lambda: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(RuntimeError):
            again.ingest(file_documents(files, OPTIONS), epoch=(checkpoint, 3), status=outcome)
    again = IndexStore(spark, root)
    assert again.ingest(file_documents(files, OPTIONS), epoch=(checkpoint, 3), status=outcome) is not None
    told = sorted((r.path.rsplit("/", 1)[1], r.status, r.reason) for r in again.status().collect() if r.path[-5] in "efg")
    assert told == [("e.txt", "indexed", None), ("f.bin", "skipped", "unsupported"), ("g.txt", "skipped", "empty")]
    assert IndexStore(spark, root).ingest(file_documents(files, OPTIONS), epoch=(checkpoint, 3), status=outcome) is None


def test_odd_names_and_vanished_files(spark, write, tmp_path, monkeypatch):
    from termloom.sources import files as source

    docs, root = write({"one.txt": "first words here"}), str(tmp_path / "index")
    index_documents(spark, docs, root, OPTIONS)
    write({"b[1].txt": "bracket name words", "c{x}.txt": "brace name words", "d*e.txt": "star name words"})
    run = index_documents(spark, docs, root, OPTIONS)
    assert run.report.first().indexed_files == 3
    known = IndexStore(spark, root).doc_stats().filter("path NOT LIKE '%name%'").limit(0)
    named = {r.filename for r in source.scan_changed(spark, docs, known).collect()}
    monkeypatch.setattr(source, "LISTED_FILES", 1)
    assert {r.filename for r in source.scan_changed(spark, docs, known).collect()} == named and len(named) == 4
    # a file that is gone when it is read gives no row
    monkeypatch.setattr(source, "LISTED_FILES", 100)
    monkeypatch.setattr(source, "_escaped", lambda paths: [*paths, docs + "/gone.txt"])
    assert {r.filename for r in source.scan_changed(spark, docs, known).collect()} == named


def test_newest_has_one_winner(spark):
    from termloom.operators.ingest import newest

    rows = [("p", None, "x"), ("p", "2024-01-02", "b"), ("p", "2024-01-02", "a"), ("q", None, "z"), ("q", None, "y")]
    frame = spark.createDataFrame(rows, "path string, t string, content_hash string").withColumn("modified_time", F.to_timestamp("t"))
    assert sorted((r.path, r.content_hash) for r in newest(frame).collect()) == [("p", "a"), ("q", "y")]


def test_new_store_is_empty_and_arguments_must_fit(spark, write, tmp_path):
    root = str(tmp_path / "index")
    assert search(IndexStore(spark, root).index(), "words").count() == 0
    assert index_stats(spark, root).first().document_count == 0
    index_documents(spark, write({"a.txt": "machines learn"}), root, IngestOptions(buckets=2, stem=True))
    assert IndexStore(spark, root).index().stem and found(spark, root, "machine learning") == ["a.txt"]
    for wrong in (dict(stem=False), dict(buckets=3)):
        with pytest.raises(ValueError):
            IndexStore(spark, root, **wrong)


def test_hidden_files_that_are_wanted(spark, write, tmp_path):
    docs = write({".h.txt": "hidden words", "a.txt": "plain words"})
    run = index_documents(spark, docs, str(tmp_path / "index"), IngestOptions(ignore_hidden=False), mounted=True)
    assert {(r.status, r.reason) for r in run.status.collect()} == {("indexed", None)}


def test_plan_of_a_lookup(spark, write, tmp_path):
    root = str(tmp_path / "index")
    docs = write({"a.txt": "first words", "b.txt": "second words"})
    index_documents(spark, docs, root, OPTIONS)
    os.utime(docs + "/a.txt", (2_000_000_000, 2_000_000_000))
    index_documents(spark, docs, root, OPTIONS)
    store = IndexStore(spark, root)
    assert store.state.removed_batches
    plan = search(store.index(), "words")._jdf.queryExecution().optimizedPlan().toString()
    # terms reach the scans, and replaced rows are removed from hits and results only
    assert "term#" in plan and ("IN (" in plan or "= words" in plan)
    for block in plan.split("LeftAnti")[1:]:
        assert block.lstrip(", (")[:4] == "path" and "Join Inner" in block
    assert set(found(spark, root, "words")) == {"a.txt", "b.txt"}


def test_counts_without_postings(spark):
    from termloom.operators import analysis

    rows = [
        ("a", "x y", "y x, X x", "a.txt", ["t", "t"]), ("a", "", "y", "a.txt", ["t", None]), (None, None, "", None, None),
        ("b", "x", "x", "b", [None, "u", "t"]),
    ]
    corpus = spark.createDataFrame(rows, "path string, title string, content string, filename string, tags array<string>")
    counted = analysis.token_stats(corpus)
    assert counted.schema.fieldNames() == ["field", "term", "df", "cf"]
    expected = analysis.term_stats(analysis.analyze(corpus)).select("field", "term", "df", "cf").collect()
    assert sorted(map(str, counted.collect())) == sorted(map(str, expected))
    assert ("content", "x", 2, 4) in {tuple(r) for r in counted.collect()}
