"""Analysis of query texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import is_blank, strip, words
from termloom.functions.wordlists import ENGLISH_STOP_WORDS

_PHRASE = r'"([^"]*)"'
_FIELD_VALUE = r"([\p{L}\p{N}_]+):(\S+)"
_BOOLEAN = r"(?i)(^|[^\p{L}\p{N}_])(AND|OR|NOT)([^\p{L}\p{N}_]|$)"
_PATTERN = r"[\p{L}\p{N}_*?]+"


def original(query: Column) -> Column:
    return F.when(is_blank(query), F.lit("")).otherwise(strip(query))


def phrases(query: Column) -> Column:
    """The texts between double quotes."""
    empty = F.array().cast("array<string>")
    return F.when(is_blank(query), empty).otherwise(F.regexp_extract_all(query, F.lit(_PHRASE), F.lit(1)))


def filters(query: Column) -> Column:
    """``field:value`` pairs as a map; the last value of a field wins."""
    fields = F.regexp_extract_all(query, F.lit(_FIELD_VALUE), F.lit(1))
    values = F.regexp_extract_all(query, F.lit(_FIELD_VALUE), F.lit(2))
    pairs = F.transform(
        fields, lambda name, i: F.struct(name.alias("key"), F.get(values, i).alias("value"), i.alias("i"))
    )
    last = F.filter(
        pairs, lambda p: ~F.exists(pairs, lambda later: (later["key"] == p["key"]) & (later["i"] > p["i"]))
    )
    entries = F.transform(last, lambda p: F.struct(p["key"], p["value"]))
    return F.map_from_entries(F.when(is_blank(query), F.slice(entries, 1, 0)).otherwise(entries))


def residual(query: Column) -> Column:
    """The query without quoted phrases and ``field:value`` pairs."""
    bare = F.regexp_replace(F.regexp_replace(query, _PHRASE, ""), _FIELD_VALUE, "")
    return F.when(is_blank(query), F.lit("")).otherwise(bare)


def search_type(query: Column, fuzzy: bool = True) -> Column:
    """phrase, wildcard, boolean, fuzzy (one word) or standard, in this order."""
    text = original(query)
    one_word = ~text.rlike(r"(?U)\s") & (text != "")
    return (
        F.when(text.rlike(_PHRASE), "phrase")
        .when(text.rlike(r"[*?]"), "wildcard")
        .when(text.rlike(_BOOLEAN), "boolean")
        .when(F.lit(fuzzy) & one_word, "fuzzy")
        .otherwise("standard")
    )


def keep_terms(
    tokens: Column,
    low: int = 3,
    high: int = 50,
    remove_stop_words: bool = True,
    custom_stop_words: tuple[str, ...] = (),
) -> Column:
    """Tokens of a fitting length that begin with a word character and are no stop words."""

    # one literal for the whole list: it is split once, when the plan is made
    stop_words = F.split(F.lit(" ".join(ENGLISH_STOP_WORDS + tuple(custom_stop_words))), " ")

    def keep(token: Column) -> Column:
        good = F.length(token).between(low, high) & token.rlike(r"^[\p{L}\p{N}_]")
        return good & ~F.array_contains(stop_words, token) if remove_stop_words else good

    return F.filter(tokens, keep)


def terms(query: Column, **limits) -> Column:
    """Query terms, unstemmed, in order and with repetitions."""
    return keep_terms(words(residual(query)), **limits)


def patterns(query: Column, **limits) -> Column:
    """Terms of a wildcard query with their ``*`` and ``?``; a pattern begins with a word character.

    A question mark that ends a query of several words is punctuation, not a wildcard.
    """
    text = F.regexp_replace(residual(query), r"(\s\S*?)\?+\s*$", "$1")
    return keep_terms(F.regexp_extract_all(F.lower(text), F.lit(_PATTERN), F.lit(0)), **limits)


def processed(query: Column, query_terms: Column) -> Column:
    """The terms joined by blanks; without any term the stripped residual text."""
    return F.when(F.size(query_terms) > 0, F.array_join(query_terms, " ")).otherwise(strip(residual(query)))


def has_operators(query: Column) -> Column:
    """Whether the text is boolean with an operator in capitals; ``and`` in prose is a word."""
    return residual(query).rlike(r"(^|[\s(])(AND|OR|NOT)([\s(]|$)")


def clauses(query: Column, **limits) -> Column:
    """Clauses of a boolean text, all of which hold: (negated, terms), any of the terms each.

    Words without an operator between them are clauses of their own, ``OR`` joins the words beside it, ``NOT``
    negates what follows it: a word, words joined by ``OR``, or every word of brackets. Brackets otherwise
    only group: an ``AND`` inside brackets that ``OR`` joins to something isn't kept together. Clauses
    without a fitting term drop out.
    """
    text = F.regexp_replace(residual(query), r"[^\p{L}\p{N}_()\s]+", " ")
    text = F.regexp_replace(text, r"(^|[\s(])NOT\s*\(\s*", "$1NOT (")
    text = F.regexp_replace(text, r"(?<=NOT \([^()]{0,500})\s+(?:(?:AND|OR)\s+)?(?=[^()\s][^()]*\))", "|")
    text = F.regexp_replace(text, r"[()]", " ")
    text = F.regexp_replace(text, r"\s+OR\s+", "|")
    text = F.regexp_replace(text, r"(^|\s)(AND|OR)(?=\s|$)", " ")
    text = F.regexp_replace(text, r"(^|\s)NOT\s+", " -")
    pieces = F.regexp_extract_all(text, F.lit(r"-?[\p{L}\p{N}_|]+"), F.lit(0))

    def clause(piece: Column) -> Column:
        found = F.split(F.lower(F.regexp_replace(piece, "^-", "")), "[|]")
        return F.struct(piece.startswith("-").alias("negated"), keep_terms(found, **limits).alias("terms"))

    return F.filter(F.transform(pieces, clause), lambda c: F.size(c["terms"]) > 0)
