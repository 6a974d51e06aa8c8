"""Words, white space, patterns and display formats as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
WORD_OR_GAP = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at both ends (not only blanks, as ``trim`` does)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def glob_to_regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored regular expression."""

    def part(piece: str) -> str:
        if piece == "*":
            return ".*"
        if piece == "?":
            return "."
        if len(piece) > 2 and piece[0] == "[" and piece[-1] == "]":
            body = piece[1:-1].replace("\\", "\\\\").replace("[", "\\[")
            return f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
        return re.escape(piece)

    pieces = re.findall(r"\[!?\]?[^\]]*\]|.", pattern, flags=re.S)
    return "(?s)^" + "".join(map(part, pieces)) + "$"


def wildcard_to_regex(pattern: Column) -> Column:
    """A ``*`` / ``?`` term pattern column as an anchored regular expression column."""
    literal = F.regexp_replace(pattern, r"([^\p{L}\p{N}_*?])", r"\\$1")
    body = F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("^"), body, F.lit("$"))


def matches_any(text: Column, globs: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for pattern in globs:
        hit = hit | text.rlike(glob_to_regex(pattern))
    return hit


def html_escape(text: Column) -> Column:
    """``& < > " '`` as character references, the ampersand first; null gives an empty text."""
    out = F.coalesce(text, F.lit(""))
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out


def _one_decimal(size: Column, unit: int) -> Column:
    """size / unit to one decimal, ties to even, in whole numbers (exact for any byte count)."""
    tenths_of = size * 10
    rest = tenths_of % unit
    quotient = F.floor((tenths_of - rest) / unit).cast("long")
    twice_rest = rest * 2
    up = (twice_rest > unit) | ((twice_rest == unit) & (quotient % 2 == 1))
    tenths = quotient + F.when(up, 1).otherwise(0)
    whole = F.floor(tenths / 10).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), (tenths % 10).cast("string"))


def file_size(size: Column) -> Column:
    """A byte count for people: ``0 B``, else one decimal and B, KB, MB, GB or TB (base 1024)."""
    size = size.cast("long")
    out = F.when(size == 0, F.lit("0 B"))
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(
            size < 1024 ** (power + 1), F.concat(_one_decimal(size, 1024**power), F.lit(" " + unit))
        )
    return out.otherwise(F.concat(_one_decimal(size, 1024**4), F.lit(" TB")))


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def date_display(value: Column) -> Column:
    """``YYYY-MM-DD HH:MM``; ``Unknown`` for a blank, the raw text when it is not a timestamp."""
    text = value.cast("string")
    # the time as it is written: an offset is cut, not applied
    local = F.when(text.rlike(_ISO), F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""))
    local = F.when(F.length(local) == 10, local).otherwise(F.regexp_replace(local, "T", " "))
    shown = F.coalesce(F.date_format(F.try_to_timestamp(local), "yyyy-MM-dd HH:mm"), text)
    return F.when(text.isNull() | (text == ""), F.lit("Unknown")).otherwise(shown)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def content_preview(content: Column, size: Column, max_lines: int = 10) -> Column:
    """The first lines in a code fence and the number of lines left; above 1 MiB a refusal."""
    lines = F.split(content, "\n")
    # a final line break ends the last line, it does not begin another one
    count = F.size(lines) - F.when(content.endswith("\n") | (content == ""), 1).otherwise(0)
    shown = F.least(count, F.lit(max_lines))
    body = F.array_join(F.slice(lines, F.lit(1), shown), "\n")
    body = F.concat(body, F.when((shown < count) | content.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))
    rest = F.when(
        count > max_lines,
        F.concat(F.lit("\n... ("), (count - max_lines).cast("string"), F.lit(" more lines)")),
    ).otherwise(F.lit(""))
    return F.when(size > 1024 * 1024, F.lit("File too large to preview")).otherwise(
        F.concat(F.lit("```\n"), body, rest, F.lit("\n```"))
    )
