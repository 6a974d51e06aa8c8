"""Batch search: a table of queries to ranked results."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import querytext
from termloom.functions.snippet import highlight, plain_snippet, plain_title, term_regex
from termloom.functions.text import wildcard_to_regex, words
from termloom.operators import match, rank
from termloom.operators.analysis import stem_vocabulary
from termloom.operators.index import Index
from termloom.operators.sizing import SMALL_QUERIES, SMALL_ROWS, is_small, pinned_table, sized
from termloom.options import SEARCH_FIELDS, SearchOptions
from termloom.plans import unstored
from termloom.sources.scratch import kept

QUERY_TYPES = ("phrase", "wildcard", "boolean", "fuzzy", "standard")


def _limits(options: SearchOptions) -> dict:
    return dict(
        low=options.min_word_length,
        high=options.max_word_length,
        remove_stop_words=options.remove_stop_words,
        custom_stop_words=options.custom_stop_words,
    )


def analyze_queries(queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
    """(query_id, query) with original, processed, terms, phrases, filters and search_type.

    A blank query gives empty values. Terms are unstemmed here (see ``stem_query_terms``).
    """
    options = options or SearchOptions()
    query = F.col("query")
    terms = querytext.terms(query, **_limits(options))
    empty = F.array().cast("array<string>")
    return queries.select(
        "query_id",
        "query",
        querytext.original(query).alias("original"),
        querytext.search_type(query, options.fuzzy).alias("search_type"),
        F.coalesce(terms, empty).alias("terms"),
        querytext.phrases(query).alias("phrases"),
        querytext.filters(F.coalesce(query, F.lit(""))).alias("filters"),
    ).withColumn("processed", querytext.processed(query, F.col("terms")))


def stem_query_terms(analysed: DataFrame) -> DataFrame:
    """Replace the terms of analysed queries by their stems; each distinct term is stemmed once."""
    places = analysed.select("query_id", F.posexplode("terms").alias("place", "term"))
    stems = stem_vocabulary(places)
    stemmed = (
        places.join(stems, "term")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", "stem")))["stem"].alias("stemmed"))
    )
    empty = F.array().cast("array<string>")
    return (
        analysed.drop("terms")
        .join(stemmed, "query_id", "left")
        .withColumn("terms", F.coalesce("stemmed", empty))
        .withColumn("processed", querytext.processed(F.col("query"), F.col("terms")))
        .drop("stemmed")
    )


def valid_queries(analysed: DataFrame, max_length: int = 500) -> DataFrame:
    """Queries that are not blank, not too long and hold a term, a phrase or a field filter."""
    return analysed.filter(
        (F.col("original") != "")
        & (F.length("original") <= max_length)
        & ((F.size("terms") > 0) | (F.size("phrases") > 0) | (F.size(F.map_keys("filters")) > 0))
    )


def _stemmed(rows: DataFrame, column: str) -> DataFrame:
    stems = stem_vocabulary(rows.select(F.col(column).alias("term"))).withColumnRenamed("term", column)
    return rows.join(stems, column).drop(column).withColumnRenamed("stem", column)


def _field_terms(rows: DataFrame, options: SearchOptions) -> DataFrame:
    """(query_id, term) in every searched field, stemmed where the field is."""
    fields = [f for f in options.fields if f in SEARCH_FIELDS]
    if not options.stem:
        return match.in_fields(rows, fields)
    parts = []
    stemmed = [f for f in fields if f in ("title", "content")]
    plain = [f for f in fields if f not in stemmed]
    if stemmed:
        parts.append(match.in_fields(_stemmed(rows, "term"), stemmed))
    if plain:
        parts.append(match.in_fields(rows, plain))
    return match.union_all([p.select("query_id", "field", "term") for p in parts])


def _filter_terms(valid: DataFrame, options: SearchOptions) -> DataFrame:
    """``field:value`` pairs as terms of that field alone; a tag is compared as it is written."""
    pairs = valid.select("query_id", F.explode("filters").alias("field", "value")).filter(
        F.col("field").isin(*SEARCH_FIELDS)
    )
    pieces = F.when(F.col("field") == "tags", F.array("value")).otherwise(words(F.col("value")))
    rows = pairs.select("query_id", "field", F.explode(pieces).alias("term"))
    if not options.stem:
        return rows
    text = F.col("field").isin("title", "content")
    return _stemmed(rows.filter(text), "term").select("query_id", "field", "term").unionByName(rows.filter(~text))


def _clause_terms(ruled: DataFrame, options: SearchOptions) -> DataFrame:
    """(query_id, clause, negated, field, term) of queries with operators."""
    clauses = ruled.select("query_id", F.posexplode(querytext.clauses(F.col("query"), **_limits(options))).alias("clause", "c"))
    rows = clauses.select(
        F.struct("query_id", "clause", F.col("c.negated").alias("negated")).alias("query_id"), F.explode("c.terms").alias("term")
    )
    return _field_terms(rows, options).select("query_id.*", "field", "term").distinct()


def _find(index: Index, terms: DataFrame, small: bool, values: list[str] | None = None) -> DataFrame:
    """Postings of the terms. Old rows of a stored index go after the lookup, which leaves few rows.

    ``values`` are the terms where they are known: sorted row groups without any of them aren't read.
    """
    postings = index.postings if index.all_postings is None else index.all_postings
    if values and index.buckets is not None:
        postings = postings.filter(F.col("term").isin(values))
    return index.live(match.lookup(postings, terms, index.buckets, small))


def _content_stats(index: Index) -> DataFrame | None:
    """Document counts of content terms where they are stored; counting them anew would read all documents again."""
    if index.buckets is None:
        return None
    return index.term_changes.filter(F.col("field") == "content").select("term", "df")


def _allowed(index: Index, clause_terms: DataFrame, small: bool) -> DataFrame:
    """(query_id, path) with a term of every positive clause and none of a negated one.

    A query with negated clauses alone allows nothing: it ranks no document.
    """
    wanted = clause_terms.filter("NOT negated").groupBy("query_id").agg(F.count_distinct("clause").alias("wanted"))
    met = _find(index, clause_terms, small)
    # the set of a (query, document) pair is bounded by the length of the query
    held = met.groupBy(*match.HIT).agg(
        F.size(F.collect_set(F.when(~F.col("negated"), F.col("clause")))).alias("held"), F.bool_or("negated").alias("barred")
    )
    return held.join(sized(wanted, small), "query_id").filter("held = wanted AND NOT barred").select(*match.HIT)


def _phrase_terms(valid: DataFrame, options: SearchOptions) -> DataFrame:
    """(phrase_id, query_id, i, term, n_terms): phrase words go through the analyzer of the content."""
    rows = (
        valid.filter(F.col("search_type") == "phrase")
        .select("query_id", F.posexplode("phrases").alias("number", "phrase"))
        .withColumn("phrase_words", words(F.col("phrase")))
        .select(
            F.struct("query_id", "number").alias("phrase_id"),
            "query_id",
            F.size("phrase_words").alias("n_terms"),
            F.posexplode("phrase_words").alias("i", "term"),
        )
    )
    return _stemmed(rows, "term") if options.stem else rows


def _phrase_sets(valid: DataFrame) -> DataFrame:
    """(query_id, key, ngrams): the distinct phrases of a query as words with a blank between them; key stands for all."""
    texts = F.transform("phrases", lambda phrase: F.array_join(words(phrase), " "))
    ngrams = F.array_sort(F.array_distinct(F.filter(texts, lambda text: text != "")))
    sets = valid.filter(F.col("search_type") == "phrase").select("query_id", ngrams.alias("ngrams")).filter(F.size("ngrams") > 0)
    return sets.select("query_id", F.array_join("ngrams", "\n").alias("key"), "ngrams")


def _pattern_sets(valid: DataFrame, options: SearchOptions) -> DataFrame:
    """(query_id, key, patterns, words) of wildcard queries: key stands for all patterns, words are those that none matches."""
    found = querytext.patterns(F.col("query"), **_limits(options))
    sets = valid.filter(F.col("search_type") == "wildcard").select(
        "query_id", F.array_sort(F.array_distinct(F.filter(found, lambda p: p.rlike("[*?]")))).alias("patterns"),
        F.filter(found, lambda p: ~p.rlike("[*?]")).alias("words"),
    )
    return sets.select("query_id", F.array_join("patterns", " ").alias("key"), "patterns", "words")


def _not_matched(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(query_id, field, term) without the words of contents that a pattern of the same query leads to."""
    own = sets.select("query_id", "patterns")
    hit = F.exists("patterns", lambda p: F.rlike(F.col("term"), wildcard_to_regex(p)))
    led = (F.col("field") == "content") & F.coalesce(hit, F.lit(False))
    return rows.join(sized(own), "query_id", "left").filter(~led).drop("patterns")


def _expansions(
    valid: DataFrame, index: Index, types: set[str], options: SearchOptions, small: bool | None, content: DataFrame
) -> list[DataFrame]:
    """Terms of wildcard and one-word queries, looked up in the (term) of contents and not in the postings."""
    parts = []
    if "wildcard" in types:
        rows = valid.filter(F.col("search_type") == "wildcard").select(
            "query_id", F.explode(querytext.patterns(F.col("query"), **_limits(options))).alias("pattern")
        )
        is_pattern = F.col("pattern").rlike("[*?]")
        parts.append(_plain(rows.filter(~is_pattern), options))
        if index.grams is None:
            expanded = match.expand_wildcards(content, rows.filter(is_pattern), small=small)
        else:
            expanded = match.expand_stored_wildcards(index.grams, rows.filter(is_pattern), index.buckets)
        parts.append(rows.join(expanded, "pattern").select("query_id", F.lit("content").alias("field"), "term"))
    if "fuzzy" in types:
        rows = valid.filter(F.col("search_type") == "fuzzy").select("query_id", F.explode("terms").alias("term"))
        rows = (_stemmed(rows, "term") if options.stem else rows).withColumnRenamed("term", "word")
        if index.variants is None:
            expanded = match.expand_fuzzy(content, rows, options.fuzzy_prefix, small=small)
        else:
            expanded = match.expand_stored_fuzzy(index.variants, rows, index.buckets, options.fuzzy_prefix)
        parts.append(rows.join(expanded, "word").select("query_id", F.lit("content").alias("field"), "term"))
    return parts


def _search_texts(index: Index, valid: DataFrame, kinds: list, options: SearchOptions, small: bool):
    """Best (query_id, path, score, rank) of an index that is not stored, and what finds the terms that a result was found by."""
    if not small:
        valid = kept(valid, "queries")
    operators = F.col("operators")
    exact = valid.filter(~F.col("search_type").isin("phrase", "wildcard") & ~operators).select(
        "query_id", F.explode("terms").alias("term")
    )
    parts = [_field_terms(exact, options), _filter_terms(valid, options)]
    ruled = valid.filter(operators) if any(row["operators"] for row in kinds) else None
    n_masks = 0
    wanted = None
    stems = unstored.stems_of(index)
    types = {row["search_type"] for row in kinds}
    if types & {"fuzzy", "wildcard"}:
        if "wildcard" in types:  # not with stems
            content = unstored.word_counts(index)
        elif stems is None:
            content = unstored.vocabulary(index, ("content",))
        else:
            content = unstored.vocabulary(index, ("content",)).join(stems, "term").select(F.col("stem").alias("term")).distinct()
        parts += _expansions(valid, index, types - {"wildcard"}, options, None, content)
    patterns = None
    if "wildcard" in types:
        sets = kept(_pattern_sets(valid, options), "patterns")
        parts.append(sets.select("query_id", F.lit("content").alias("field"), F.explode("words").alias("term")))
        parts = [_not_matched(match.union_all([p.select("query_id", "field", "term") for p in parts]), sets)]
        patterns = sets.filter(F.size("patterns") > 0)
        parts.append(patterns.select("query_id", F.lit(unstored.PATTERN).alias("field"), F.col("key").alias("term")))
        each = kept(patterns.select("key", F.explode("patterns").alias("pattern")).distinct(), "patterns")
        keyed = each.join(match.expand_wildcards(content, each), "pattern").select("key", "term").distinct()
        led = unstored.led_by(content, keyed)
    phrases = None
    if "phrase" in types:
        phrases = kept(_phrase_sets(valid), "phrases")
        parts.append(phrases.select("query_id", F.lit(unstored.PHRASE).alias("field"), F.col("key").alias("term")))
        ngrams = kept(phrases.select("key", F.explode("ngrams").alias("ngram")).distinct(), "phrases")
        phrase_words = kept(ngrams.select("key", F.explode(F.split("ngram", " ")).alias("term")).distinct(), "phrases")
        found = unstored.phrase_documents(index, ngrams)
    terms = match.union_all([p.select("query_id", "field", "term") for p in parts]).distinct()
    if ruled is not None:
        clause_terms = kept(_clause_terms(ruled, options), "clauses")
        n_clauses = (clause_terms.agg(F.max("clause")).first()[0] or 0) + 1
        n_masks = -(-n_clauses // unstored.BITS)
        nothing = [F.lit(None).cast("int").alias("clause"), F.lit(False).alias("negated")]
        flagged = terms.select("*", *nothing).unionByName(clause_terms.select("query_id", "field", "term", "clause", "negated"))
        clause, negated = F.col("clause"), F.col("negated")
        flags = [F.bool_or(~negated).alias("counts"), F.bool_or(negated).alias("barred")]
        terms = flagged.groupBy("query_id", "field", "term").agg(*flags, *unstored.masks(clause, negated, n_clauses))
        full = [m.alias(f"want{j}") for j, m in enumerate(unstored.masks(clause, negated, n_clauses))]
        rules = ruled.select("query_id").distinct().join(clause_terms.groupBy("query_id").agg(*full), "query_id", "left")
        wanted = kept(rules.withColumn("ruled", F.lit(True)), "rules")
    terms = kept(terms, "terms")
    n_terms = terms.count()
    keys = terms.select("field", "term")
    if phrases is not None:
        keys = keys.unionByName(phrase_words.select(F.lit("content").alias("field"), "term"))
    keys = kept(keys.distinct(), "words")
    every = keys.select("term").distinct()
    few = is_small(keys)
    counted = unstored.count(index, every, stems)
    stats = counted.field_stats()
    dfs = unstored.document_counts(counted.postings())
    weighed = kept(dfs.join(sized(keys, few), ["field", "term"]).join(F.broadcast(stats), "field"), "weights")
    few_weights = is_small(weighed)

    def scored(documents: DataFrame) -> DataFrame:
        """(path, field, term, part) of the terms in counted documents."""
        part = rank.term_score(options.scorer).alias("part")
        hits = replace(counted, rows=documents).postings().join(sized(weighed, few_weights), ["field", "term"])
        return hits.select("path", "field", "term", part)

    weights = weighed.select("field", "term", "df")
    n_pairs = terms.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).join(weights, ["field", "term"]).agg(
        F.sum(F.col("n") * F.col("df"))
    ).first()[0] or 0
    if patterns is not None:
        n_docs = stats.filter(F.col("field") == "content").select("n_docs").collect()
        n_pairs += unstored.pattern_pairs(led, terms, n_docs[0]["n_docs"] if n_docs else 0)
        texts = index.tokens.filter(F.col("field") == "content").select("path", "tokens")
    allowed = None
    attributes = _attributes(options)
    if attributes and options.filter_stage == "before_topk":
        allowed = rank.filter_attributes(index.corpus, **attributes).select("path")

    def best(share: int | None, least: DataFrame | None) -> DataFrame:
        def own_share(rows: DataFrame) -> DataFrame:
            rows = rows if share is None else rows.filter(F.pmod(F.xxhash64("path"), F.lit(share)) == 0)
            return rows if allowed is None else rows.join(allowed, "path", "left_semi")

        n_own = n_pairs // (share or 1)
        hits = unstored.by_document(scored(own_share(counted.rows)), n_own)
        n_tasks = unstored.tasks(hits, n_own)
        if phrases is not None:
            hits = unstored.with_phrases(hits, found, phrase_words, n_tasks)
        if patterns is not None:
            hits = hits.unionByName(unstored.pattern_parts(own_share(texts), led, stats, options.scorer, n_tasks))
        ranked = []
        for own in unstored.blocks(terms, n_terms):
            pairs = rank.at_least(unstored.add_up(hits, own, True, wanted, n_masks), options.min_score)
            if least is not None:
                pairs = pairs.join(sized(least), "query_id", "left").filter("least IS NULL OR score >= least").drop("least")
            ranked.append(rank.top_k(pairs, options.limit))
        return match.union_all(ranked)

    least = None
    if n_pairs > unstored.MANY_PAIRS:
        # the last of the best documents of a share is a bound for the whole: what scores less isn't ranked
        share = best(unstored.SHARE, None).filter(F.col("rank") == options.limit)
        least = kept(share.select("query_id", F.col("score").alias("least")), "least")
    results = kept(best(None, least), "best")

    def matched(results: DataFrame) -> DataFrame:
        """The results with ``matched``: the terms of their queries that their documents hold."""
        pairs = results.select(*match.HIT)
        if _marks_own(options):
            # what the words of the query mark needs no look at the document
            known = _own_words(valid).filter(~F.col("filtered")).select("query_id")
            pairs = kept(pairs.join(sized(known), "query_id", "left_anti"), "pairs")
            if pairs.isEmpty():
                return results.withColumn("matched", F.array().cast("array<string>"))
        held = pairs.join(counted.postings().select("path", "field", "term"), "path")
        scoring = (terms.filter("counts") if ruled is not None else terms).select("query_id", "field", "term")
        # the many words of results do not travel to the terms of the queries, which are few
        met = held.join(sized(scoring), ["query_id", "field", "term"], "left_semi")
        if phrases is not None:
            # words of phrases where one of the phrases is
            places = phrases.select("query_id", "key").join(found, "key").join(pairs, match.HIT, "left_semi")
            rows = places.join(phrase_words, "key").select(*match.HIT, F.lit("content").alias("field"), "term")
            met = met.unionByName(held.join(rows, held.columns, "left_semi").select(met.columns))
        if patterns is not None:
            met = met.unionByName(_pattern_words(pairs, patterns, texts, led))
        found_terms = kept(met.groupBy(*match.HIT).agg(F.collect_set("term").alias("matched")), "matched")
        return results.join(sized(found_terms), match.HIT, "left")

    return results, matched


def _pattern_words(pairs: DataFrame, patterns: DataFrame, texts: DataFrame, led: unstored.Led) -> DataFrame:
    """(query_id, path, field, term): the words that the patterns of a query lead to in the contents of its results."""
    places = kept(pairs.join(patterns.select("query_id", "key"), "query_id"), "places")
    # a document carries the keys it is asked for, so that no word of it travels to find them
    wanted = places.groupBy("path").agg(F.collect_set("key").alias("wanted"))
    words = texts.join(sized(wanted), "path").select("path", "wanted", F.explode(F.array_distinct("tokens")).alias("term"))
    asked = F.explode(F.array_intersect("keys", "wanted")).alias("key")
    found = kept(match.union_all([rows.select("path", "term", asked) for rows in led.of(words)]), "marked")
    return found.join(sized(places), ["path", "key"]).select(*match.HIT, F.lit("content").alias("field"), "term")


def _attributes(options: SearchOptions) -> dict:
    found = dict(file_types=options.file_types, max_size=options.max_size, modified_after=options.modified_after)
    return found if any(value is not None for value in found.values()) else {}


def _plain(rows: DataFrame, options: SearchOptions) -> DataFrame:
    rows = rows.select("query_id", F.col("pattern").alias("term"))
    rows = _stemmed(rows, "term") if options.stem else rows
    return rows.select("query_id", F.lit("content").alias("field"), "term")


def _marks_own(options: SearchOptions) -> bool:
    return not options.stem and {"title", "content"} <= set(options.fields)


def _own_words(valid: DataFrame) -> DataFrame:
    """(query_id, own, filtered) of plain queries: each of their words is marked, a word that the cut of a fragment leaves too."""
    plain = valid.filter(F.col("search_type").isin("standard", "boolean") & ~F.col("operators"))
    return plain.select("query_id", F.array_distinct("terms").alias("own"), (F.size(F.map_keys("filters")) > 0).alias("filtered"))


def _with_own_words(results: DataFrame, valid: DataFrame, options: SearchOptions, small: bool) -> DataFrame:
    if not _marks_own(options):
        return results
    joined = results.join(sized(_own_words(valid).drop("filtered"), small), "query_id", "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("matched", F.array_union(F.coalesce("matched", none), F.coalesce("own", none))).drop("own")


def _matched_words(results: DataFrame, stem: bool) -> DataFrame:
    """``matched`` as the words to be marked: with stems, those of the result's own words that have one of the stems."""
    if not stem:
        return results
    held = results.select("query_id", "path", "matched", F.explode(F.array_distinct(F.concat(
        words(F.coalesce("content", F.lit(""))), words(F.coalesce("title", F.lit("")))))).alias("term"))
    stems = stem_vocabulary(held)
    hit = F.array_contains("matched", F.col("stem")) | F.array_contains("matched", F.col("term"))
    marked = held.join(stems, "term").filter(hit).groupBy(*match.HIT).agg(F.collect_set("term").alias("marked"))
    empty = F.array().cast("array<string>")
    return results.join(marked, match.HIT, "left").withColumn("matched", F.coalesce("marked", empty)).drop("marked")


def with_snippets(results: DataFrame, length: int = 200, stem: bool = False) -> DataFrame:
    """Turn ``matched`` into ``highlights`` and ``content_snippet``; a field without a hit shows its beginning.

    What is marked is what matched: the words that a wildcard, a misspelt word or a stem has led to.
    """
    found = _matched_words(results, stem)
    # a tag with other characters than those of words can't be a word of the text
    regex = term_regex(F.array_sort(F.filter("matched", lambda t: t.rlike(r"^[\p{L}\p{N}_]+$"))))
    joined = found.withColumn("regex", regex)
    regex = F.col("regex")
    content = F.coalesce(highlight(F.col("content"), regex, length), plain_snippet(F.col("content"), length))
    title = F.coalesce(highlight(F.col("title"), regex, 100), plain_title(F.col("title")))
    return (
        joined.withColumn("highlights", F.struct(content.alias("content"), title.alias("title")))
        .withColumn("content_snippet", F.left(F.col("highlights.content"), F.lit(length)))
        .drop("regex", "matched")
    )


def batch_search(index: Index, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
    """Search for every row of (query_id, query).

    Returns (query_id, rank, score, the document attributes, highlights, content_snippet). Order of
    work: match, score, top-k, minimum score, filters, sort, new ranks, snippets. Only paths, term
    frequencies and scores take part up to the top-k; contents are read for the results alone.
    """
    options = options or SearchOptions()
    if options.stem != index.stem:  # terms go through the analyzer of the index
        options = replace(options, stem=index.stem)
    valid = valid_queries(analyze_queries(queries, options), options.max_query_length)
    n_terms = F.size("terms") * len(options.fields) + F.size(words(F.col("original")))
    operators = (F.col("search_type") == "boolean") & querytext.has_operators(F.col("query"))
    # the analysed queries are used in several places; what they hold decides what is planned
    valid = valid.withColumns({"n_terms": n_terms, "operators": operators})
    valid, rows = pinned_table(valid, SMALL_QUERIES)
    if rows is None:
        kinds = valid.groupBy("search_type").agg(
            F.count(F.lit(1)).alias("n_queries"), F.sum("n_terms").alias("n_terms"), F.bool_or("operators").alias("operators")
        ).collect()  # five rows at most
    else:
        counted = rows.group_by("search_type").aggregate([("query_id", "count"), ("n_terms", "sum"), ("operators", "any")])
        kinds = counted.rename_columns({"query_id_count": "n_queries", "n_terms_sum": "n_terms", "operators_any": "operators"}).to_pylist()
    types = {row["search_type"] for row in kinds}
    small = rows is not None and sum(row["n_terms"] for row in kinds) <= SMALL_ROWS
    # of an index with stems, hits of phrases and patterns are dealt by query
    dealt = types & ({"phrase", "wildcard"} if options.stem else set()) if index.tokens is not None else types
    if index.tokens is None or dealt and dealt == types:
        return _shown(_in_postings(index, valid, kinds, options, small), options)
    if not dealt:
        return _shown(_in_documents(index, valid, kinds, options, small), options)
    by_query = F.col("search_type").isin(*sorted(dealt))
    found = _in_documents(index, valid.filter(~by_query), [row for row in kinds if row["search_type"] not in dealt], options, small)
    rest = _in_postings(index, valid.filter(by_query), [row for row in kinds if row["search_type"] in dealt], options, small)
    return _shown(found.unionByName(rest), options)


def _in_documents(index: Index, valid: DataFrame, kinds: list, options: SearchOptions, small: bool) -> DataFrame:
    """Results with attributes from an index that is not stored."""
    best, matched = _search_texts(index, valid, kinds, options, small)
    few = is_small(best)
    # contents and attributes are made of the results alone: the semi join goes below what makes them
    corpus = index.corpus.join(sized(best.select("path").distinct(), few), "path", "left_semi")
    best = _with_own_words(matched(best), valid, options, small) if options.highlight else best
    return rank.attach_attributes(best, corpus, small=few)


def _in_postings(index: Index, valid: DataFrame, kinds: list, options: SearchOptions, small: bool) -> DataFrame:
    """Results with attributes from postings, whose hits are dealt by query and document."""
    types = {row["search_type"] for row in kinds}
    n_queries = sum(row["n_queries"] for row in kinds)
    operators = F.col("operators")

    exact = valid.filter(~F.col("search_type").isin("phrase", "wildcard") & ~operators).select(
        "query_id", F.explode("terms").alias("term")
    )
    parts = [_field_terms(exact, options), _filter_terms(valid, options)]
    ruled = valid.filter(operators) if any(row["operators"] for row in kinds) else None
    if ruled is not None:
        clause_terms = _clause_terms(ruled, options)
        parts.append(clause_terms.filter("NOT negated"))
    content = index.term_stats.filter(F.col("field") == "content")
    expansions = _expansions(valid, index, types, options, small, content) if types & {"wildcard", "fuzzy"} else []
    terms = match.union_all([p.select("query_id", "field", "term") for p in parts + expansions]).distinct()
    few_terms, values = small, None
    if expansions or small and index.buckets is not None:  # how many there are depends on the vocabulary
        terms, found = pinned_table(terms, SMALL_ROWS)
        few_terms = found is not None
        values = found["term"].unique().to_pylist() if few_terms and found.num_rows <= match.NAMED else None
    stats = index.term_stats if index.term_changes is None else index.term_changes
    if values and index.buckets is not None:
        stats = stats.filter(F.col("term").isin(values))
    weighed = rank.weigh_terms(terms, stats, index.field_stats, few_terms, index.buckets)
    matched = [_find(index, weighed, few_terms, values)]
    columns = ["query_id", "path", "field", "term", "tf", "doc_len", "df", "n_docs", "avg_len"]
    if "phrase" in types:
        phrases = _phrase_terms(valid, options)
        found = match.phrase_hits(
            _find(index, phrases.select("term", F.lit("content").alias("field")).distinct(), small).select("path", "term", "positions"),
            phrases.drop("query_id"), small, _content_stats(index),
        ).select(F.col("phrase_id.query_id").alias("query_id"), "path").distinct()
        rows = phrases.select("query_id", F.lit("content").alias("field"), "term").distinct()
        every = index.term_stats if index.term_changes is None else index.term_changes
        scored_terms = rank.weigh_terms(rows, every, index.field_stats, small, index.buckets)
        hits = _find(index, scored_terms, small)
        matched.append(hits.join(found, match.HIT, "left_semi"))
    scored = rank.score_hits(match.union_all([m.select(*columns) for m in matched]), options.scorer, options.highlight)

    if ruled is not None:
        by_rule = ruled.select("query_id", F.lit(True).alias("ruled"))
        allowed = _allowed(index, clause_terms, small).withColumn("allowed", F.lit(True))
        scored = (
            scored.join(sized(by_rule, small), "query_id", "left")
            .join(allowed, match.HIT, "left")
            .filter("ruled IS NULL OR allowed")
            .drop("ruled", "allowed")
        )

    attributes = _attributes(options)
    if attributes and options.filter_stage == "before_topk":
        allowed = rank.filter_attributes(index.corpus, **attributes).select("path")
        scored = scored.join(allowed, "path", "left_semi")
    # the order is by score, so a minimum before the top-k keeps the same rows as one after it
    best = rank.top_k(rank.at_least(scored, options.min_score), options.limit)
    best = _with_own_words(best, valid, options, small) if options.highlight else best
    few = n_queries * options.limit <= SMALL_ROWS
    corpus = index.corpus if index.all_corpus is None else index.all_corpus
    return index.live(rank.attach_attributes(best, corpus, index.buckets, few))


def _shown(results: DataFrame, options: SearchOptions) -> DataFrame:
    """Results with attributes: filters after the top-k, sort, new ranks, snippets."""
    attributes = _attributes(options)
    if attributes and options.filter_stage == "after_topk":
        results = rank.filter_attributes(results, **attributes)
    results = rank.sort_results(results, options.sort_by, options.descending)
    if options.highlight:
        results = with_snippets(results, options.snippet_length, options.stem)
    else:
        results = results.withColumn("highlights", F.struct(F.lit("").alias("content"), F.lit("").alias("title")))
        results = results.withColumn("content_snippet", F.lit(""))
    return results.select(*rank.RESULT_COLUMNS, "highlights", "content_snippet")


def search(index: Index, query: str, options: SearchOptions | None = None) -> DataFrame:
    """Results of one query text, in rank order."""
    spark = index.corpus.sparkSession
    queries = spark.createDataFrame([(0, query)], "query_id long, query string")
    return batch_search(index, queries, options).orderBy("rank")
