"""Plain and highlighted snippets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import WORD_OR_GAP

#: characters shown before the first hit
LEAD = 40


def plain_snippet(content: Column, length: int = 200) -> Column:
    return F.when(F.length(content) > length, F.concat(F.left(content, F.lit(length)), F.lit("..."))).otherwise(
        content
    )


def plain_title(title: Column, length: int = 100) -> Column:
    return F.left(title, F.lit(length))


def term_regex(terms: Column) -> Column:
    """Alternatives for an array of terms or ``*`` / ``?`` patterns, for whole words."""
    inner = F.array_join(terms, "|")
    inner = F.replace(inner, F.lit("*"), F.lit(r"[\p{L}\p{N}_]*"))
    return F.replace(inner, F.lit("?"), F.lit(r"[\p{L}\p{N}_]"))


def first_hit(text: Column, regex: Column) -> Column:
    """1-based place of the first word that matches, 0 when none does."""
    whole = F.concat(F.lit(r"(?iu)[^\p{L}\p{N}_](?:"), regex, F.lit(r")(?:[^\p{L}\p{N}_]|$)"))
    # the blank in front stands for the separator of a first word, so the place needs no correction
    return F.regexp_instr(F.concat(F.lit(" "), text), whole)


def fragment(text: Column, regex: Column, length: int) -> Column:
    """Up to ``length`` characters around the first hit; null when there is none."""
    hit = first_hit(text, regex)
    start = F.greatest(hit - LEAD, F.lit(1))
    return F.when((hit > 0) & (regex != ""), F.substring(text, start, F.lit(length)))


def mark(text: Column, regex: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """Wrap each whole word that matches."""
    whole = F.concat(F.lit("(?iu)^(?:"), regex, F.lit(")$"))
    pieces = F.regexp_extract_all(text, F.lit(WORD_OR_GAP), F.lit(0))
    wrapped = F.transform(
        pieces, lambda p: F.when(F.rlike(p, whole), F.concat(F.lit(before), p, F.lit(after))).otherwise(p)
    )
    return F.array_join(wrapped, "")


def highlight(text: Column, regex: Column, length: int, before: str = "<b>", after: str = "</b>") -> Column:
    """Highlighted fragment of at most ``length`` characters of text; null without a hit."""
    return mark(fragment(text, regex, length), regex, before, after)
