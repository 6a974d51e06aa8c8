"""One named query for each operator, over the given tables.

Each takes (spark, folder of the tables) and returns a DataFrame. Arrays and maps are shown as
texts and scores are rounded, so that results can be compared across engines.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import document, extract, querytext, text
from termloom.functions.snippet import plain_snippet, plain_title
from termloom.functions.wordlists import CUSTOM_STOP_WORDS, DEFAULT_EXCLUDES, DEFAULT_FORMATS, ENGLISH_STOP_WORDS
from termloom.operators import analysis, ingest, match, querylog, rank, report, suggest, tagging
from termloom.operators.index import FIELD_NAMES, Index, index_of
from termloom.operators.sizing import spread_if_small
from termloom.options import SEARCH_FIELDS, SearchOptions
from termloom.plans import search, unstored
from termloom.sources import tables
from termloom.sources.files import scan_files
from termloom.sources.scratch import shared_folder
from termloom.sources.store import IndexStore

#: query terms of the matching and scoring queries
TERMS = {1: ["that", "thtion", "queeux"], 2: ["the", "tionand"], 3: ["für", "ich"]}
ALL_TERMS = {1: ["that", "the"], 2: ["for", "with", "src3"], 3: ["und", "ein", "der"]}
PHRASES = [(1, "of the"), (2, "the the"), (3, "que le un"), (4, "ein und")]
PATTERNS = ["thtion*", "th?t", "que*x", "?n", "*ement", "zz*"]
MISSPELT = ["taht", "thtion", "queuex", "heed"]
PREFIX = "tha"
SIZE_CAP_MB = 0.004
#: whole benchmark texts are queries, however long they are
MAX_QUERY = 1_000_000
EXCLUDES = DEFAULT_EXCLUDES + ("*/src5/*",)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- inputs ------------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    # long texts are worth one task for each core even where the table is one row group
    return spread_if_small(rows) if name in ("documents", "pages", "conversations") else rows


def documents_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return tables.as_corpus(tables.documents_as_files(table(spark, folder, "documents")), markup=False)


def pages_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return tables.as_corpus(tables.pages_as_files(table(spark, folder, "pages")))


def landing_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as files with names of several kinds, taken from language and source."""
    source = F.col("source")
    suffix = (
        F.when(source == "src0", ".log")
        .when(source == "src1", ".PDF")
        .when(source == "src2", ".MD")
        .when(source == "src3", ".Html")
        .otherwise(".txt")
    )
    hidden = F.when(F.col("lang") == "es", ".").otherwise("")
    files = table(spark, folder, "documents").select(
        F.concat(F.lit("/landing/"), source, F.lit("/"), hidden, F.col("doc_id").cast("string"), suffix).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("modified_time"),
        F.col("text").alias("content"),
    )
    name = document.filename(F.col("path"))
    return files.withColumn("filename", name).withColumn("extension", document.extension(name))


def batch_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each benchmark item as a query."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, w): every six words in a row of each benchmark item; an item of fewer words is one window."""
    letters = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    items = table(spark, folder, "benchmark").select("item_id", letters.alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 6, F.lit(0)))
    return items.select("item_id", "all", F.explode(starts).alias("start")).select(
        (F.col("item_id") * 100_000 + F.col("start")).alias("id"), F.slice("all", F.col("start") + 1, F.lit(6)).alias("w")
    )


def _word(i: int) -> Column:
    return F.coalesce(F.get("w", F.lit(i)), F.lit(""))


def _texts(windows: DataFrame, kinds: Column, n: int) -> DataFrame:
    return windows.select(F.posexplode(kinds).alias("k", "query"), "id").select(
        (F.col("id") * n + F.col("k")).alias("query_id"), "query"
    )


def mixed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Six query texts of different kinds from every six words of each benchmark item."""
    w = [_word(i) for i in range(6)]
    sp, quote = F.lit(" "), F.lit('"')
    kinds = F.array(
        F.concat(quote, w[0], sp, w[1], quote, F.lit(" filename:"), w[2]),
        F.concat(w[1], F.lit("* "), w[2]),
        F.concat(w[0], F.lit(" AND "), w[1], F.lit(" title:"), w[3], F.lit(" title:"), w[4]),
        w[3],
        F.concat(sp, w[2], F.lit("  of "), w[4], sp, w[5], F.lit("! ")),
        F.lit(" \n "),
    )
    return _texts(_windows(spark, folder), kinds, 6)


def boolean_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Five boolean texts from every six words of each benchmark item."""
    w = [_word(i) for i in range(6)]
    kinds = F.array(
        F.concat(w[0], F.lit(" AND "), w[1], F.lit(" "), w[2]),
        F.concat(w[0], F.lit(" OR "), w[1], F.lit(" "), w[2]),
        F.concat(F.lit("NOT "), w[3], F.lit(" "), w[4]),
        F.concat(w[3], F.lit(" AND ("), w[4], F.lit(" OR "), w[5], F.lit(")")),
        F.concat(w[5], F.lit(" "), w[4], F.lit(" NOT "), w[0]),
    )
    return _texts(_windows(spark, folder), kinds, 5)


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a query log: value is the search time, k the number of results."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("query_id"),
        F.col("event_type").alias("query"),
        "ts",
        F.get_json_object("props", "$.k").cast("long").alias("total_results"),
        F.col("value").alias("search_time"),
    )


def content_index(spark: SparkSession, folder: str, terms: dict[int, list[str]] | None = None) -> Index:
    return index_of(documents_corpus(spark, folder), fields=("content",), terms=_flat(terms))


def _flat(terms: dict[int, list[str]] | None) -> tuple[str, ...] | None:
    return None if terms is None else tuple(sorted({t for ts in terms.values() for t in ts}))


def terms_in(spark: SparkSession, fields=("content",), terms=None) -> DataFrame:
    return match.query_terms(spark, terms or TERMS, fields)


def matched(spark: SparkSession, folder: str, fields=("content",), terms=None) -> DataFrame:
    index = index_of(documents_corpus(spark, folder), fields=tuple(fields), terms=_flat(terms or TERMS))
    return match.lookup(index.postings, terms_in(spark, fields, terms))


def scored(spark: SparkSession, folder: str, scorer: str) -> DataFrame:
    index = content_index(spark, folder, TERMS)
    weighed = rank.weigh_terms(terms_in(spark), index.term_stats, index.field_stats)
    return rank.score_hits(match.lookup(index.postings, weighed, small=True), scorer)


def shown_score():
    return F.round("score", 6).alias("score")


# --- scans, sources, sinks -----------------------------------------------------------------------


@query
def corpus_scan(spark, folder):
    files = scan_files(spark, folder).filter(F.col("extension") == ".parquet")
    return files.select("filename", "extension")


@query
def hidden_file_filter(spark, folder):
    return ingest.not_hidden(landing_files(spark, folder)).select("path")


@query
def exclude_globs(spark, folder):
    return ingest.not_excluded(landing_files(spark, folder), EXCLUDES).select("path")


@query
def supported_extensions(spark, folder):
    return ingest.supported(landing_files(spark, folder), DEFAULT_FORMATS).select("path", "extension")


@query
def size_cap(spark, folder):
    return ingest.at_most(landing_files(spark, folder), SIZE_CAP_MB).select("path", "size")


@query
def blank_content_filter(spark, folder):
    # what is left without letters, digits and marks is blank for some texts
    files = landing_files(spark, folder).withColumn("content", F.regexp_replace("content", r"[^\s.]", ""))
    return ingest.not_empty(files).select("path")


@query
def incremental_filter(spark, folder):
    files = landing_files(spark, folder)
    return ingest.changed(files, index_state(files)).select("path")


def index_state(files: DataFrame) -> DataFrame:
    """An earlier index of the files: some are missing, small ones are older than their files."""
    shift = F.when(F.col("size") > 1000, F.expr("INTERVAL 1 MINUTE")).otherwise(F.expr("INTERVAL -1 MINUTE"))
    return files.filter(F.col("extension") != ".md").withColumn("modified_time", F.col("modified_time") + shift)


@query
def upsert_by_path(spark, folder):
    old = landing_files(spark, folder).select("path", "size", "content")
    pages = tables.pages_as_files(table(spark, folder, "pages"))
    changed = old.filter(F.col("size") > 1000).withColumn("content", F.concat("content", F.lit(" changed")))
    new = changed.unionByName(pages.select("path", "size", F.col("text").alias("content")))
    return ingest.upsert(old, new).select("path", "size", document.content_hash(F.col("content")).alias("content_hash"))


@query
def newest_version(spark, folder):
    files = landing_files(spark, folder).select("path", "modified_time", "content")
    later = files.filter(F.length("content") > 1000).select(
        "path", (F.col("modified_time") + F.expr("INTERVAL 1 HOUR")).alias("modified_time"),
        F.concat("content", F.lit(" changed")).alias("content"),
    )
    # a version is asked for its hash alone, so hashes and not texts travel to their path
    versions = files.unionByName(later).withColumn("content_hash", document.content_hash(F.col("content"))).drop("content")
    return ingest.newest(versions).select("path", "content_hash")


@query
def index_statistics(spark, folder):
    return ingest.index_stats(documents_corpus(spark, folder), FIELD_NAMES, "index", "1")


def _status(spark, folder):
    """Every fifth size is that of a file that is gone when it is read."""
    files = landing_files(spark, folder).withColumn("error", F.when(F.col("size") % 5 == 0, "No such file or directory"))
    files = files.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
    files = files.withColumn("word_count", document.word_count(F.col("content")))
    return ingest.ingest_status(files, EXCLUDES, DEFAULT_FORMATS, SIZE_CAP_MB, index_state(files))


@query
def ingest_status_rows(spark, folder):
    return _status(spark, folder)


@query
def ingest_report_counts(spark, folder):
    return ingest.ingest_report(_status(spark, folder))


@query
def result_export(spark, folder):
    return report.json_lines(_few_results(spark, folder))


# --- extraction ------------------------------------------------------------------------------------


@query
def extractor_routing(spark, folder):
    files = landing_files(spark, folder)
    content = extract.extract_text(F.col("extension"), F.col("content"))
    return files.select("path", document.content_hash(content).alias("content_hash"))


@query
def text_decoding(spark, folder):
    # broken bytes around the text must vanish and nothing else
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return table(spark, folder, "documents").select(
        "doc_id", document.content_hash(extract.decode_text(raw)).alias("content_hash")
    )


@query
def text_decoding_utf16(spark, folder):
    raw = F.encode("text", "UTF-16")
    return table(spark, folder, "documents").select(
        "doc_id", document.content_hash(extract.decode_text(raw, "UTF-16")).alias("content_hash")
    )


@query
def html_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", extract.html_to_text(F.col("html")).alias("content"))


@query
def markdown_text(spark, folder):
    """Each document on a page with every kind of mark around some of its words."""
    letters = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    rows = table(spark, folder, "documents").select("doc_id", "text", letters.alias("w")).filter(F.size("w") >= 6)
    page = (
        "# {1} {2} #\n\n{text}\n\n* {3} **{4}** __{5}__\n- [{6}](http://a.example/{1}) ![{2}](x.png)\n1. *{3}* _{4}_ `{5}`\n\n"
        "> {6} <https://b.example/{1}>\n\n```python\n{2} = 1\n```\n\n{3}\n===\n\n---\n\n"
        "<b>{4}</b> &amp; &lt;{5}&gt; <!-- {6} -->\n\n[ref]: http://c.example\n[{1}][ref]"
    )
    parts = [
        F.col("text") if p == "text" else F.get("w", F.lit(int(p) - 1)) if p.isdigit() and len(p) == 1 and i % 2 else F.lit(p)
        for i, p in enumerate(re.split(r"[{}]", page))
    ]
    return rows.select("doc_id", document.content_hash(extract.markdown_to_text(F.concat(*parts))).alias("content_hash"))


# --- document projections -------------------------------------------------------------------------


@query
def file_attributes(spark, folder):
    files = landing_files(spark, folder)
    return files.select(
        "path", "filename", "extension", "size", document.parent(F.col("path")).alias("parent"),
        F.date_format("modified_time", "yyyy-MM-dd HH:mm:ss").alias("modified_time"),
    )


@query
def content_hashes(spark, folder):
    return documents_corpus(spark, folder).select("path", "content_hash")


@query
def word_counts(spark, folder):
    return documents_corpus(spark, folder).select("path", "word_count")


@query
def titles(spark, folder):
    return documents_corpus(spark, folder).select("path", "title")


@query
def page_titles(spark, folder):
    return pages_corpus(spark, folder).select("path", "title")


@query
def line_counts(spark, folder):
    return documents_corpus(spark, folder).select("path", "metadata.line_count")


@query
def char_counts(spark, folder):
    return documents_corpus(spark, folder).select("path", "metadata.char_count")


@query
def paragraph_counts(spark, folder):
    return documents_corpus(spark, folder).select("path", "metadata.paragraph_count")


@query
def mime_types(spark, folder):
    files = landing_files(spark, folder)
    return files.join(F.broadcast(document.mime_table(spark)), "extension", "left").select("path", "mime_type")


@query
def metadata_records(spark, folder):
    return documents_corpus(spark, folder).select("path", F.to_json("metadata").alias("metadata"))


@query
def entity_tags(spark, folder):
    return tagging.tag_documents(documents_corpus(spark, folder), _entities(spark, folder)).select(
        "path", F.array_join("tags", "|").alias("tags")
    )


def _entities(spark, folder):
    """A dictionary from the first two words of each sentence of the benchmark; a long one is a date, which is no tag."""
    sentences = table(spark, folder, "benchmark").select(F.explode(F.split("text", r"[.\n]\s*")).alias("sentence"))
    first = F.regexp_extract("sentence", r"^(\p{L}+ \p{L}+)", 1)
    label = F.when(F.length("sentence") > 60, "DATE").when(F.length(first) > 12, "ORG").otherwise("PERSON")
    return sentences.select(first.alias("text"), label.alias("label")).filter("text != ''").distinct()


# --- analysis ----------------------------------------------------------------------------------------


@query
def token_positions(spark, folder):
    tokens = analysis.explode_tokens(analysis.content_tokens(documents_corpus(spark, folder)))
    return tokens.select("path", "pos", "term")


@query
def term_length_filter(spark, folder):
    index = content_index(spark, folder)
    return analysis.drop_short_and_long(index.term_stats).select("term", "df")


@query
def stop_word_filter(spark, folder):
    index = content_index(spark, folder)
    return analysis.drop_stop_words(index.term_stats, ENGLISH_STOP_WORDS + CUSTOM_STOP_WORDS).select("term", "df")


@query
def punctuation_filter(spark, folder):
    marks = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(text.WORD_OR_MARK), F.lit(0)))
    counts = table(spark, folder, "documents").select(marks.alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")
    )
    return analysis.starts_with_word(counts)


@query
def stemmed_vocabulary(spark, folder):
    return analysis.stem_vocabulary(content_index(spark, folder).term_stats)


@query
def stemmed_postings(spark, folder):
    postings = analysis.analyze(documents_corpus(spark, folder), stem=True)
    return postings.select("path", "field", "term", "tf", F.array_join("positions", ",").alias("positions"))


@query
def postings(spark, folder):
    rows = content_index(spark, folder).postings
    return rows.select("path", "field", "term", "tf", F.array_join("positions", ",").alias("positions"))


@query
def field_analyzers(spark, folder):
    rows = analysis.analyze(documents_corpus(spark, folder), fields=("title", "filename", "tags"))
    return rows.select("path", "field", "term", "tf")


@query
def term_statistics(spark, folder):
    return content_index(spark, folder).term_stats


@query
def field_statistics(spark, folder):
    stats = index_of(documents_corpus(spark, folder)).field_stats
    return stats.select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query
def document_lengths(spark, folder):
    return analysis.doc_stats(analysis.field_tokens(documents_corpus(spark, folder)))


# --- matching ------------------------------------------------------------------------------------------


@query
def term_match(spark, folder):
    return matched(spark, folder, terms={1: ["thtion"]}).select("path", "tf")


@query
def any_of_multi_field(spark, folder):
    return match.any_of(matched(spark, folder, SEARCH_FIELDS))


@query
def any_of_content(spark, folder):
    return match.any_of(matched(spark, folder))


@query
def all_of(spark, folder):
    terms = terms_in(spark, SEARCH_FIELDS, ALL_TERMS)
    return match.all_of(matched(spark, folder, SEARCH_FIELDS, ALL_TERMS), terms)


@query
def none_of(spark, folder):
    hits = match.any_of(matched(spark, folder, terms={1: ["the", "of"]}))
    return match.none_of(documents_corpus(spark, folder).select("path"), hits)


@query
def nested_boolean(spark, folder):
    """that AND (thtion OR tionand) AND NOT und"""
    a = match.any_of(matched(spark, folder, terms={1: ["that"]}))
    b = match.any_of(matched(spark, folder, terms={1: ["thtion", "tionand"]}))
    c = match.any_of(matched(spark, folder, terms={1: ["und"]}))
    return match.none_of(match.both(a, b), c)


@query
def phrase_match(spark, folder):
    terms = tuple(sorted({w for _, p in PHRASES for w in p.split()}))
    postings = analysis.invert(analysis.content_tokens(documents_corpus(spark, folder)), terms=terms)
    return match.phrase_hits(postings, match.phrase_rows(spark, PHRASES))


@query
def wildcard_expansion(spark, folder):
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return match.expand_wildcards(content_index(spark, folder).term_stats, patterns)


@query
def wildcard_match(spark, folder):
    # the words are both expanded and looked up: counted once, and without positions, which no pair asks for
    postings = unstored.count_all(content_index(spark, folder)).postings()
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    terms = match.expand_wildcards(unstored.document_counts(postings), patterns).withColumn("field", F.lit("content"))
    return match.lookup(postings, terms).select("pattern", "path").distinct()


def _fuzzy(spark, folder, prefix_length):
    words = spark.createDataFrame([(w,) for w in MISSPELT], "word string")
    return match.expand_fuzzy(content_index(spark, folder).term_stats, words, prefix_length)


@query
def fuzzy_expansion(spark, folder):
    return _fuzzy(spark, folder, 0)


@query
def fuzzy_expansion_same_start(spark, folder):
    return _fuzzy(spark, folder, 1)


@query
def fuzzy_match(spark, folder):
    postings = unstored.count_all(content_index(spark, folder)).postings()
    words = spark.createDataFrame([(w,) for w in MISSPELT], "word string")
    terms = match.expand_fuzzy(unstored.document_counts(postings), words, 0).withColumn("field", F.lit("content"))
    return match.lookup(postings, terms).select("word", "path").distinct()


@query
def field_scoped_term(spark, folder):
    return matched(spark, folder, ("filename", "tags"), {1: ["fr", "12"], 2: ["src3", "txt"]}).select(
        "query_id", "field", "term", "path"
    )


# --- ranking ---------------------------------------------------------------------------------------------


@query
def bm25_scores(spark, folder):
    return scored(spark, folder, "bm25").select("query_id", "path", shown_score())


@query
def tfidf_scores(spark, folder):
    return scored(spark, folder, "tfidf").select("query_id", "path", shown_score())


@query
def minimum_score(spark, folder):
    best = rank.at_least(rank.top_k(scored(spark, folder, "bm25")), 2.0)
    return best.select("query_id", "rank", "path", shown_score())


@query
def top_k(spark, folder):
    best = rank.top_k(scored(spark, folder, "bm25"), 20)
    return best.select("query_id", "rank", "path", shown_score())


@query
def top_k_single(spark, folder):
    one = scored(spark, folder, "bm25").filter("query_id = 1")
    return rank.top_k_single(one, 20).select("query_id", "rank", "path", shown_score())


def _results(spark, folder, **changes):
    options = SearchOptions(fuzzy=False, max_query_length=MAX_QUERY, **changes)
    index = index_of(documents_corpus(spark, folder))
    return search.batch_search(index, batch_queries(spark, folder), options)


FILTERS = dict(file_types=(".txt", ".md"), max_size=2500, modified_after="2024-01-01 02:00:00")


@query
def filters_after_top_k(spark, folder):
    rows = _results(spark, folder, highlight=False, **FILTERS)
    return rows.select("query_id", "rank", "path", shown_score())


@query
def filters_before_top_k(spark, folder):
    rows = _results(spark, folder, highlight=False, filter_stage="before_topk", **FILTERS)
    return rows.select("query_id", "rank", "path", shown_score())


def _sorted(spark, folder, key, descending):
    rows = _results(spark, folder, highlight=False, sort_by=key, descending=descending)
    return rows.select("query_id", "rank", "path")


@query
def sort_by_filename(spark, folder):
    return _sorted(spark, folder, "filename", True)


@query
def sort_by_size_ascending(spark, folder):
    return _sorted(spark, folder, "size", False)


@query
def sort_by_modified_time(spark, folder):
    return _sorted(spark, folder, "modified_time", True)


@query
def sort_by_word_count(spark, folder):
    return _sorted(spark, folder, "word_count", True)


@query
def sort_by_unknown_key(spark, folder):
    return _sorted(spark, folder, "colour", True)


@query
def highlights(spark, folder):
    return _highlights(_results(spark, folder))


def _highlights(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "rank", "path", "highlights.content", "highlights.title", "content_snippet")


@query
def highlights_expanded(spark, folder):
    """What wildcards and misspelt words have found, marked."""
    kinds = mixed_queries(spark, folder).filter("query_id % 6 IN (1, 3)")
    return _highlights(search.batch_search(index_of(documents_corpus(spark, folder)), kinds))


@query
def highlights_stemmed(spark, folder):
    options = SearchOptions(fuzzy=False, max_query_length=MAX_QUERY)
    index = index_of(documents_corpus(spark, folder), stem=True)
    return _highlights(search.batch_search(index, batch_queries(spark, folder), options))


@query
def plain_snippets(spark, folder):
    corpus = documents_corpus(spark, folder)
    return corpus.select(
        "path", plain_snippet(F.col("content")).alias("snippet"), plain_title(F.col("title")).alias("title")
    )


@query
def result_records(spark, folder):
    rows = _results(spark, folder, highlight=False)
    return rows.select(
        "query_id", "rank", shown_score(), "path", "filename", "title", "extension", "size", "word_count",
        F.date_format("modified_time", "yyyy-MM-dd HH:mm:ss").alias("modified_time"),
        F.array_join("tags", ",").alias("tags"), "metadata.line_count",
    )


@query
def valid_queries(spark, folder):
    analysed = search.analyze_queries(_any_queries(spark, folder))
    return search.valid_queries(analysed, 150).select("query_id", "query")


@query
def suggestions(spark, folder):
    return suggest.suggestions(index_of(documents_corpus(spark, folder)).term_stats, PREFIX, 5)


@query
def flagship_search(spark, folder):
    """that, thtion or queeux in a content: the best 20 documents by BM25 with their attributes."""
    index = content_index(spark, folder, {1: TERMS[1]})
    weighed = rank.weigh_terms(terms_in(spark, terms={1: TERMS[1]}), index.term_stats, index.field_stats)
    hits = rank.score_hits(match.lookup(index.postings, weighed, small=True))
    rows = rank.attach_attributes(rank.top_k_single(hits, 20), index.corpus, small=True)
    return rows.select("query_id", "rank", shown_score(), "path", "title", "word_count")


@query
def batch_search(spark, folder):
    return _results(spark, folder, highlight=False).select("query_id", "rank", "path", shown_score())


@query
def stored_search(spark, folder):
    """batch_search on an index that is stored in two batches; the second puts right what the first has of every third document."""
    store = IndexStore(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", buckets=8)
    documents = table(spark, folder, "documents")
    wrong = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Other words\n"), "text")).otherwise(F.col("text"))
    first = tables.as_corpus(tables.documents_as_files(documents.withColumn("text", wrong)), markup=False)
    store.ingest(first, unique_paths=True)
    store.ingest(tables.as_corpus(tables.documents_as_files(documents.filter("doc_id % 3 = 0")), markup=False))
    options = SearchOptions(fuzzy=False, max_query_length=MAX_QUERY, highlight=False)
    rows = search.batch_search(store.index(), batch_queries(spark, folder), options)
    return rows.select("query_id", "rank", "path", shown_score())


@query
def stored_wildcards(spark, folder):
    """wildcard_expansion and fuzzy_expansion over the stored tables of an index."""
    store = IndexStore(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", buckets=8)
    store.ingest(documents_corpus(spark, folder), unique_paths=True)
    index = store.index()
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    words = spark.createDataFrame([(w,) for w in MISSPELT], "word string")
    wild = match.expand_stored_wildcards(index.grams, patterns, index.buckets)
    fuzzy = match.expand_stored_fuzzy(index.variants, words, index.buckets, 0)
    return wild.unionByName(fuzzy.select(F.col("word").alias("pattern"), "term"))


@query
def batch_search_tfidf(spark, folder):
    rows = _results(spark, folder, highlight=False, scorer="tfidf")
    return rows.select("query_id", "rank", "path", shown_score())


@query
def batch_search_all_kinds(spark, folder):
    options = SearchOptions(highlight=False, fuzzy_prefix=1)
    index = index_of(documents_corpus(spark, folder))
    rows = search.batch_search(index, mixed_queries(spark, folder), options)
    # scores have nine digits: half of the last one keeps a six-digit tie from being cut either way
    return rows.select("query_id", "rank", "path", F.round(F.col("score") + 5e-10, 6).alias("score"))


@query
def batch_search_boolean(spark, folder):
    index = index_of(documents_corpus(spark, folder))
    rows = search.batch_search(index, boolean_queries(spark, folder), SearchOptions(highlight=False))
    return rows.select("query_id", "rank", "path", shown_score())


@query
def batch_search_stemmed(spark, folder):
    index = index_of(documents_corpus(spark, folder), stem=True)
    options = SearchOptions(stem=True, highlight=False, fuzzy=False, max_query_length=MAX_QUERY)
    rows = search.batch_search(index, batch_queries(spark, folder), options)
    return rows.select("query_id", "rank", "path", shown_score())


# --- query texts -----------------------------------------------------------------------------------------


def _any_queries(spark, folder):
    """The mixed queries and every conversation turn as a query text."""
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000_000).alias("query_id"), F.col("text").alias("query")
    )
    return mixed_queries(spark, folder).unionByName(turns)


@query
def query_phrases(spark, folder):
    phrases = querytext.phrases(F.col("query"))
    return mixed_queries(spark, folder).select("query_id", F.array_join(phrases, "|").alias("phrases"))


@query
def query_filters(spark, folder):
    entries = F.array_sort(F.map_entries(querytext.filters(F.col("query"))))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return mixed_queries(spark, folder).select("query_id", shown.alias("filters"))


@query
def query_residuals(spark, folder):
    return mixed_queries(spark, folder).select("query_id", querytext.residual(F.col("query")).alias("residual"))


@query
def query_types(spark, folder):
    return _any_queries(spark, folder).select("query_id", querytext.search_type(F.col("query")).alias("search_type"))


@query
def query_terms(spark, folder):
    analysed = search.analyze_queries(_any_queries(spark, folder))
    return analysed.select("query_id", F.array_join("terms", "|").alias("terms"))


@query
def query_terms_stemmed(spark, folder):
    analysed = search.stem_query_terms(search.analyze_queries(_any_queries(spark, folder)))
    return analysed.select("query_id", F.array_join("terms", "|").alias("terms"), "processed")


@query
def analyzed_queries(spark, folder):
    analysed = search.analyze_queries(mixed_queries(spark, folder))
    return analysed.select(
        "query_id", "original", "processed", "search_type", F.size("terms").alias("n_terms"),
        F.size("phrases").alias("n_phrases"),
    )


# --- query log --------------------------------------------------------------------------------------------


@query
def log_retention(spark, folder):
    return querylog.retain_last(log(spark, folder)).select("query_id", "query", "total_results")


@query
def log_statistics(spark, folder):
    return querylog.search_stats(log(spark, folder)).select(
        "total_searches",
        F.round("average_search_time", 6).alias("average_search_time"),
        F.round("average_results_per_search", 6).alias("average_results_per_search"),
    )


@query
def log_recent_queries(spark, folder):
    return querylog.recent_queries(log(spark, folder)).select(F.array_join("recent_queries", ",").alias("recent_queries"))


@query
def log_records(spark, folder):
    records = querylog.search_records(batch_queries(spark, folder), _results(spark, folder, highlight=False), 0.25)
    return records.select("query_id", "query", "total_results", "search_time")


# --- reports ------------------------------------------------------------------------------------------------


def _few_results(spark, folder):
    index = index_of(documents_corpus(spark, folder))
    return search.batch_search(index, batch_queries(spark, folder), SearchOptions(fuzzy=False, limit=5, max_query_length=MAX_QUERY))


def _typed_results(spark, folder):
    """Results with file types of several kinds, by the source of the document."""
    kind = F.regexp_extract("path", r"^src([0-9])", 1)
    suffix = F.when(kind.isin("0", "2"), ".md").when(kind == "1", ".html").when(kind == "5", "").otherwise(".txt")
    return _results(spark, folder, highlight=False).withColumn("extension", suffix)


@query
def result_statistics(spark, folder):
    entries = F.map_entries("file_types")
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return report.result_stats(_typed_results(spark, folder)).select(
        "query_id", "total_results", "average_score", shown.alias("file_types")
    )


@query
def summary_lines(spark, folder):
    return report.summary_lines(batch_queries(spark, folder), _typed_results(spark, folder), 0.5)


@query
def related_directories(spark, folder):
    rows = report.related_directories(_results(spark, folder, highlight=False))
    return rows.select("query_id", F.array_join("directories", "|").alias("directories"))


@query
def rendered_markdown(spark, folder):
    return report.render(batch_queries(spark, folder), _few_results(spark, folder), "markdown")


@query
def rendered_plain(spark, folder):
    return report.render(batch_queries(spark, folder), _few_results(spark, folder), "plain", details=False)


@query
def rendered_html(spark, folder):
    return report.render(batch_queries(spark, folder), _few_results(spark, folder), "html")


@query
def rendered_json(spark, folder):
    return report.render(batch_queries(spark, folder), _few_results(spark, folder), "json")


@query
def file_sizes(spark, folder):
    sizes = landing_files(spark, folder).select("path", "size")
    # bytes, and the same numbers as larger units
    return sizes.select(
        "path", text.file_size(F.col("size") % 900).alias("bytes"), text.file_size(F.col("size")).alias("size"),
        text.file_size(F.col("size") * 3001).alias("large"), text.file_size(F.col("size") * 5_000_011_111).alias("huge"),
    )


@query
def date_displays(spark, folder):
    """Times as texts of several kinds: with and without parts and offsets, and texts that are no times."""
    events = table(spark, folder, "events")
    stamp = lambda form: F.date_format("ts", form)
    kinds = F.array(
        stamp("yyyy-MM-dd'T'HH:mm:ss"), F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), stamp("yyyy"),
        stamp("yyyy-MM-dd"), F.concat(stamp("yyyy-MM-dd HH:mm:ss"), F.lit(".250Z")), stamp("HH:mm:ss"),
        stamp("yyyy-MM-dd'T'HH:mm"), F.lit(""), F.lit("soon"),
    )
    return events.select("event_id", text.date_display(F.get(kinds, (F.col("event_id") % 9).cast("int"))).alias("shown"))


@query
def html_escaping(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query
def content_previews(spark, folder):
    corpus = documents_corpus(spark, folder)
    # a size of over one MiB for the longest texts
    size = F.when(F.col("size") > 20_000, 2_000_000).otherwise(F.col("size"))
    return corpus.select("path", text.content_preview(F.col("content"), size).alias("preview"))
