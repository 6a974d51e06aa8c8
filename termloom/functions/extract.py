"""Text extraction from HTML and Markdown columns."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import strip

HTML_FORMATS = (".html", ".htm")
MARKDOWN_FORMATS = (".md",)

_ENTITY_OR_TEXT = r"&(?:#[xX]?[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"
_LINE_BREAK_OR_TWO_SPACES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]|  "

_DROPPED = (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)",
    r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)",
    r"<[!?][^>]*>",
    # a quoted attribute value may hold a '>'; possessive, so that broken mark-up cannot backtrack
    r"""</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""",
    r"</?[a-zA-Z][^>]*>",
)

_MARKDOWN_RULES = (
    (r"\r\n?", "\n"),
    (r"(?m)^ {0,3}(?:```|~~~)[^\n]*\n?", ""),  # code fences; their content stays
    (r"!\[[^\]]*\]\([^)]*\)", ""),  # images have no text
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),  # inline links
    (r"(?m)^ {0,3}\[[^\]]+\]:[ \t]*\S+[^\n]*\n?", ""),  # link definitions
    (r"\[([^\]]+)\]\[[^\]]*\]", "$1"),  # reference links
    (r"<(https?://[^>\s]+)>", "$1"),  # automatic links
    (r"(?m)^[ \t]*(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", ""),  # rules
    (r"(?m)^=+[ \t]*$", ""),  # underlined headings
    (r"(?m)^#{1,6}[ \t]*([^\n]*?)[ \t]*#*[ \t]*$", "$1"),  # headings
    (r"(?m)^[ \t]*>[ \t]?", ""),  # quotations
    (r"(?m)^[ \t]*(?:[-*+]|[0-9]+\.)[ \t]+", ""),  # list items
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"(^|[^\p{L}\p{N}_])_([^_\n]+)_($|[^\p{L}\p{N}_])", "$1$2$3"),
    (r"`([^`\n]*)`", "$1"),
)


def decode_text(raw: Column, encoding: str = "utf-8") -> Column:
    """Bytes as text without the bytes that cannot be decoded.

    Other encodings than UTF-8 are those of Spark's ``decode`` in which every text of whole characters can be
    decoded: US-ASCII (its bytes beyond 127 go), ISO-8859-1, UTF-16, UTF-16LE, UTF-16BE and UTF-32.
    """
    name = encoding.upper().replace("_", "-")
    if name in ("US-ASCII", "ASCII"):
        return F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[^\x00-\x7F]", "")
    if name in ("ISO-8859-1", "LATIN-1"):
        return F.decode(raw, "ISO-8859-1")
    if name not in ("UTF-8", "UTF8"):
        width = 4 if name.startswith("UTF-32") else 2
        whole = F.substring(raw, F.lit(1), F.octet_length(raw) - F.octet_length(raw) % width)
        return F.regexp_replace(F.decode(whole, name), "\uFEFF|\uFFFD", "")
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\uFFFD"), F.lit(""))


def drop_markup(html: Column) -> Column:
    """No comments, scripts, styles, declarations and tags; nothing is put in their place."""
    return reduce(lambda text, pattern: F.regexp_replace(text, pattern, ""), _DROPPED, html)


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Named and numeric character references as characters, each decoded once."""
    table = "\n".join(f"{name}\t{chr(code)}" for name, code in name2codepoint.items())
    names = F.str_to_map(F.lit(table), F.lit("\n"), F.lit("\t"))  # folded to one literal

    def decoded(piece: Column) -> Column:
        name = piece.substr(F.lit(2), F.length(piece) - 2)
        is_hex = name.rlike("^#[xX]")
        digits = F.when(is_hex, name.substr(F.lit(3), F.length(name))).otherwise(
            name.substr(F.lit(2), F.length(name))
        )
        number = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        numeric = F.when(valid, _code_point(number))
        known = F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(names, name))
        return F.when(piece.startswith("&") & (F.length(piece) > 2), F.coalesce(known, piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(_ENTITY_OR_TEXT), F.lit(0))
    # a text without '&' needs no work on its pieces
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Visible text: lines and double blanks separate chunks, which one blank joins again."""
    chunks = F.split(decode_entities(drop_markup(html)), _LINE_BREAK_OR_TWO_SPACES)
    return F.array_join(F.filter(F.transform(chunks, strip), lambda chunk: chunk != ""), " ")


def markdown_to_text(markdown: Column) -> Column:
    """Rendered text of Markdown: marks are dropped, blocks stand on lines of their own."""
    text = reduce(lambda out, rule: F.regexp_replace(out, *rule), _MARKDOWN_RULES, markdown)
    text = decode_entities(drop_markup(text))
    return strip(F.regexp_replace(text, r"\n[ \t]*(?:\n[ \t]*)+", "\n"))


def extract_text(extension: Column, text: Column) -> Column:
    """Text by file extension; an unknown extension is read as plain text."""
    return (
        F.when(extension.isin(*HTML_FORMATS), html_to_text(text))
        .when(extension.isin(*MARKDOWN_FORMATS), markdown_to_text(text))
        .otherwise(text)
    )
