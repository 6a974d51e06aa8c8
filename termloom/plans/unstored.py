"""Batch search of an index that is not stored: what a document scores stays with the document.

The terms of the queries are known first, so that texts are cut into words and only those of a query are counted and
kept (``count``). A hit is not shuffled: scored terms are dealt by path, meet the queries there, and a (query, document)
pair is added up in the task of its document. Phrases are found as whole word n-grams and then stand for one term.
The patterns of a query stand for one term too: their words are added up where a text is cut into words, so that texts
travel once and the many words that a pattern leads to don't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import analysis, match, rank
from termloom.operators.index import Index, mean_lengths
from termloom.operators.sizing import is_small, sized
from termloom.sources.scratch import kept

#: clauses of one bit mask
BITS = 62
#: (query, document) pairs of one task, and those from which a share of the documents gives a least score first
TASK_PAIRS = 4_000_000
MANY_PAIRS = 20_000_000
SHARE = 64
#: rows of the queries' terms that are broadcast at once
BLOCK_ROWS = 1_000_000


#: words that are broadcast with what they stand for; rarer ones meet it in a join of their few rows
WORD_ROWS = 500_000

#: the fields of what stands for the phrases and for the patterns of a query
PHRASE = "phrase"
PATTERN = "pattern"


@dataclass(frozen=True)
class Counted:
    """Counted terms of the documents: rows of ``analysis.count_terms``, for what doesn't know its terms before."""

    rows: DataFrame
    stems: None = None

    def postings(self) -> DataFrame:
        """(path, field, doc_len, term, tf)"""
        return self.rows.select("path", "field", "doc_len", F.inline("counted"))


@dataclass(frozen=True)
class Wanted:
    """(row, path, field, doc_len, term, tf) of the wanted terms; each row of tokens also has one without a term."""

    rows: DataFrame

    def postings(self) -> DataFrame:
        """(path, field, doc_len, term, tf)"""
        return self.rows.filter("term IS NOT NULL").drop("row")

    def field_stats(self) -> DataFrame:
        documents = self.rows.filter("term IS NULL")
        return mean_lengths(documents.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("total_len")))


def count_all(index: Index) -> Counted:
    """Every term of an index without stems, counted in one pass over the texts."""
    return Counted(kept(analysis.count_terms(index.tokens), "counted"))


def vocabulary(index: Index, fields: tuple[str, ...]) -> DataFrame:
    """(term): the distinct words of text fields."""
    rows = index.tokens.filter(F.col("field").isin(*fields)).select(F.explode("tokens").alias("term"))
    return kept(rows.distinct(), "vocabulary")


def word_counts(index: Index) -> DataFrame:
    """(term, df): the distinct words of contents with the number of their documents."""
    rows = index.tokens.filter(F.col("field") == "content").select(F.explode(F.array_distinct("tokens")).alias("term"))
    return kept(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "vocabulary")


def stems_of(index: Index) -> DataFrame | None:
    """(term, stem) of the vocabulary of an index with stems."""
    return kept(analysis.stem_vocabulary(vocabulary(index, analysis.STEMMED_FIELDS)), "stems") if index.stem else None


def count(index: Index, wanted: DataFrame, stems: DataFrame | None = None) -> Wanted:
    """One pass over the texts that counts the wanted (term); with ``stems`` those of title and content are stems."""
    named = wanted.select("term", F.col("term").alias("named"))
    keys, stemmed = ["term"], F.lit(False)
    if stems is not None:
        # what leads to the terms is looked up in the vocabulary, so that words meet nothing else
        led = stems.join(sized(wanted.withColumnRenamed("term", "stem")), "stem", "left_semi")
        led = led.select("term", F.col("stem").alias("named"), F.lit(True).alias("stemmed"))
        named = kept(named.withColumn("stemmed", F.lit(False)).unionByName(led), "named")
        keys, stemmed = ["stemmed", "term"], F.col("field").isin(*analysis.STEMMED_FIELDS)
    # rows of one path, and those without a path, are told apart by a number
    rows = index.tokens.select(
        F.monotonically_increasing_id().alias("row"), "path", "field", F.size("tokens").cast("long").alias("doc_len"),
        stemmed.alias("stemmed"), analysis.countable(F.col("tokens"), F.col("field")).alias("tokens"),
    )
    row = ["row", "path", "field", "doc_len"]
    # stems of one path and length are merged, as in ``merge_stems``
    own = F.when(~F.col("stemmed") | F.col("named").isNull(), F.col("row")).alias("row")
    if is_small(named, BLOCK_ROWS):
        nothing = F.array(F.lit(None).cast("string"))
        words = rows.select(*row, "stemmed", F.explode(F.concat(nothing, "tokens")).alias("term"))
        found = words.join(F.broadcast(named), keys, "left").filter("term IS NULL OR named IS NOT NULL")
        counted = found.groupBy(own, *row[1:], F.col("named").alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    else:
        # words are counted before they are shuffled
        words = rows.select(*row, "stemmed", F.explode("tokens").alias("term")).groupBy(*row, "stemmed", "term").agg(
            F.count(F.lit(1)).alias("tf")
        )
        found = words.join(named, keys).groupBy(own, *row[1:], F.col("named").alias("term")).agg(F.sum("tf").alias("tf"))
        counted = found.unionByName(
            rows.select(*row, F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf"))
        )
    return Wanted(kept(counted, "counted"))


def phrase_documents(index: Index, phrases: DataFrame) -> DataFrame:
    """(key, path) of documents whose content holds one of the phrases of a (key, ngram)."""
    wanted = phrases.select("key", "ngram", (F.size(F.split("ngram", " "))).alias("n"))
    lengths = sorted(row["n"] for row in wanted.select("n").distinct().collect())  # a row for each length

    def ngrams(n: int):
        if n == 1:
            return F.col("tokens")
        begins = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - (n - 1)))
        joined = F.transform(begins, lambda i: F.concat_ws(" ", *[F.element_at("tokens", i + j) for j in range(n)]))
        return F.coalesce(joined, F.array().cast("array<string>"))

    all_ngrams = F.array_distinct(F.concat(F.array().cast("array<string>"), *[ngrams(n) for n in lengths]))
    held = index.tokens.filter(F.col("field") == "content").select("path", F.explode(all_ngrams).alias("ngram"))
    # as in ``match.phrase_hits``, a phrase isn't found in documents that share a path
    found = held.join(sized(wanted.drop("n")), "ngram").groupBy("key", "ngram", "path").agg(F.count(F.lit(1)).alias("n"))
    return kept(found.filter("path IS NOT NULL AND n = 1").select("key", "path").distinct(), "phrases")


def with_phrases(hits: DataFrame, found: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """The hits and, as (path, PHRASE, key, part), what the words of the phrases (key, term) add where a phrase is.

    The phrases of a document lie in one row, by word, that its hits meet in its task: a frequent word of many phrases
    is not paired with documents that hold none of them.
    """
    led = found.join(sized(words), "key").groupBy("path", "term").agg(F.collect_list("key").alias("keys"))
    places = led.repartition(parts, "path").groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "keys"))).alias("places")
    )
    own = F.array(F.struct("field", "term"))
    keys = F.when(F.col("field") == "content", F.try_element_at("places", F.col("term")))
    added = F.transform(keys, lambda key: F.struct(F.lit(PHRASE).alias("field"), key.alias("term")))
    every = F.when(keys.isNull(), own).otherwise(F.concat(own, added))
    met = hits.join(places.hint("shuffle_hash"), "path", "left")
    return met.select("path", F.explode(every).alias("at"), "part").select("path", "at.field", "at.term", "part")


@dataclass(frozen=True)
class Led:
    """What the words of contents lead to: (term, df, keys), the patterns a word matches; ``rare`` words aren't broadcast."""

    frequent: DataFrame
    rare: DataFrame | None

    def of(self, rows: DataFrame, rare_rows=None) -> list[DataFrame]:
        """The rows (…, term) with (df, keys), those of frequent words in the task that has them.

        ``rare_rows`` makes fewer rows of those that no frequent word is met by.
        """
        held = self.frequent.filter(F.size("keys") > 0)
        found = [rows.join(F.broadcast(held), "term")]
        if self.rare is not None:
            others = (rare_rows or (lambda known: rows.join(known, "term", "left_anti")))(F.broadcast(self.frequent.select("term")))
            found.append(others.join(self.rare, "term"))
        return found


def led_by(counts: DataFrame, keyed: DataFrame) -> Led:
    """From the (term, df) of a vocabulary and the (key, term) of patterns."""
    keys = keyed.groupBy("term").agg(F.collect_set("key").alias("keys"))
    words = counts.join(keys, "term", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    words = kept(words, "led")
    if is_small(words, WORD_ROWS):
        return Led(words, None)
    # the numbers of words of each count are few: words with the same one stay together
    sizes = words.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).collect()
    least, n = sizes[0]["df"] + 1, 0
    for row in sizes:
        n += row["n"]
        if n > WORD_ROWS:
            break
        least = row["df"]
    return Led(words.filter(F.col("df") >= least), words.filter((F.col("df") < least) & (F.size("keys") > 0)))


def pattern_parts(texts: DataFrame, led: Led, stats: DataFrame, scorer: str, parts: int) -> DataFrame:
    """(path, PATTERN, key, part): what the words that the patterns of a key lead to add in a content, dealt by path.

    ``texts`` is (path, tokens) of contents. They are dealt as texts, which are shorter than their words with numbers.
    """
    dealt = texts.select("path", F.array_join("tokens", " ").alias("text")).repartition(parts, "path")
    cut = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " "))
    tokens = dealt.select("path", F.inline(F.array(F.struct(F.lit("content").alias("field"), cut.alias("tokens")))))
    postings = analysis.counted_postings(tokens).drop("field")

    def rare_rows(known: DataFrame) -> DataFrame:
        rows = tokens.select(
            F.monotonically_increasing_id().alias("row"), "path", F.size("tokens").cast("long").alias("doc_len"), "tokens"
        )
        words = rows.select("row", "path", "doc_len", F.explode("tokens").alias("term")).join(known, "term", "left_anti")
        return words.groupBy("row", "path", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf")).drop("row")

    content = F.broadcast(stats.filter(F.col("field") == "content").drop("field"))
    hits = [
        rows.crossJoin(content).select("path", F.explode("keys").alias("term"), rank.term_score(scorer).alias("part"))
        for rows in led.of(postings, rare_rows)
    ]
    hits[1:] = [rows.repartition(parts, "path") for rows in hits[1:]]
    # texts and rows of rare words were dealt alike: nothing travels for the sums
    summed = match.union_all(hits).groupBy("path", "term").agg(F.sum("part").alias("part"))
    return summed.select("path", F.lit(PATTERN).alias("field"), "term", "part")


def pattern_pairs(led: Led, terms: DataFrame, n_docs: int) -> int:
    """A bound for the (query, document) pairs of patterns."""
    words = led.frequent if led.rare is None else led.frequent.unionByName(led.rare)
    held = words.select(F.explode("keys").alias("term"), "df").groupBy("term").agg(F.sum("df").alias("df"))
    asked = terms.filter(F.col("field") == PATTERN).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return held.join(asked, "term").agg(F.sum(F.col("n") * F.least("df", F.lit(n_docs)))).first()[0] or 0


def document_counts(postings: DataFrame) -> DataFrame:
    """(field, term, df)"""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def masks(clause, negated, n_clauses: int) -> list:
    """Bits of the positive clauses that a term belongs to, in as many longs as it takes."""
    return [
        F.bit_or(F.when(~negated & (F.floor(clause / BITS) == j), F.expr("shiftleft(1L, int(clause % 62))"))).alias(f"mask{j}")
        for j in range(-(-n_clauses // BITS))
    ]


def tasks(rows: DataFrame, n_pairs: int) -> int:
    """As many tasks as the pairs to come are worth."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_pairs // TASK_PAIRS))


def by_document(scored: DataFrame, n_pairs: int) -> DataFrame:
    """Scored terms dealt by path."""
    return scored.repartition(tasks(scored, n_pairs), "path")


def blocks(terms: DataFrame, n_terms: int) -> list[DataFrame]:
    """The terms of the queries in parts that can be broadcast; a query is in one of them."""
    n = max(1, -(-n_terms // BLOCK_ROWS))
    return [terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [terms]


def add_up(scored: DataFrame, terms: DataFrame, small: bool, wanted: DataFrame | None, n_masks: int) -> DataFrame:
    """(query_id, path, score) from scored (path, field, term) and the queries' (query_id, field, term).

    ``scored`` is dealt by path, so pairs are added up where they are. With ``wanted`` (query_id, ruled, want0, …), the
    clauses of queries with operators, only pairs with a term of each positive clause and of no negated one are left.
    """
    pairs = scored.join(sized(terms, small), ["field", "term"])
    if wanted is None:
        return pairs.groupBy(*match.HIT).agg(F.round(F.sum("part"), rank.SCORE_DIGITS).alias("score"))
    total = F.round(F.sum(F.when(F.col("counts"), F.col("part"))), rank.SCORE_DIGITS).alias("score")
    held = [F.coalesce(F.bit_or(f"mask{j}"), F.lit(0).cast("long")).alias(f"mask{j}") for j in range(n_masks)]
    summed = pairs.groupBy(*match.HIT).agg(total, F.bool_or("barred").alias("barred"), *held)
    ruled = summed.join(sized(wanted, small), "query_id", "left")
    full = F.lit(True)
    for j in range(n_masks):
        full = full & (F.col(f"mask{j}") == F.col(f"want{j}"))
    # a document without a path meets no clause
    good = F.col("ruled").isNull() | (~F.col("barred") & full & F.col("path").isNotNull())
    return ruled.filter(good & F.col("score").isNotNull()).select(*match.HIT, "score")
