"""One search result as Markdown, plain text or HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import date_display, file_size, html_escape, thousands

# The layout of a rendered answer. {…} are filled in per query or result.
HEADERS = {
    "markdown": (
        "# No Results Found\n\nSorry, no documents were found matching **'{query}'**.\n",
        "# 1 Document Found\n\nFound 1 document matching **'{query}'**:\n",
        "# {count} Documents Found\n\nFound {count} documents matching **'{query}'**:\n",
    ),
    "plain": (
        "NO RESULTS FOUND\n{rule}\nSorry, no documents were found matching '{query}'.\n",
        "1 DOCUMENT FOUND\n{rule}\nFound 1 document matching '{query}':\n",
        "{count} DOCUMENTS FOUND\n{rule}\nFound {count} documents matching '{query}':\n",
    ),
    "html": (
        "<h1>No Results Found</h1>\n<p>Sorry, no documents were found matching <strong>'{query}'</strong>.</p>\n"
        "<div class='search-results'>",
        "<h1>1 Document Found</h1>\n<p>Found 1 document matching <strong>'{query}'</strong>:</p>\n"
        "<div class='search-results'>",
        "<h1>{count} Documents Found</h1>\n<p>Found {count} documents matching <strong>'{query}'</strong>:</p>\n"
        "<div class='search-results'>",
    ),
}
ITEMS = {
    "markdown": "## {rank}. {title}\n**File:** `{filename}`\n**Path:** `{path}`\n**Score:** {score}",
    "plain": "{rank}. {title}\n   File: {filename}\n   Path: {path}\n   Score: {score}",
    "html": "<div class='result-item' data-rank='{rank}'>\n<h2>{rank}. {title}</h2>\n"
    "<p><strong>File:</strong> <code>{filename}</code></p>\n"
    "<p><strong>Path:</strong> <code>{path}</code></p>\n<p><strong>Score:</strong> {score}</p>",
}
PREVIEWS = {
    "markdown": "\n\n**Preview:**\n> {snippet}",
    "plain": "\n   Preview: {snippet}",
    "html": "\n<div class='preview'><strong>Preview:</strong></div>\n<blockquote>{snippet}</blockquote>",
}
DETAILS = {
    "markdown": "\n\n**Details:**\n- Size: {size}\n- Words: {words}\n- Modified: {modified}",
    "plain": "\n   Size: {size}\n   Words: {words}\n   Modified: {modified}",
    "html": "\n<div class='details'>\n<p><strong>Size:</strong> {size}</p>\n"
    "<p><strong>Words:</strong> {words}</p>\n<p><strong>Modified:</strong> {modified}</p>",
}
TAGS = {
    "markdown": "\n- Tags: {tags}",
    "plain": "\n   Tags: {tags}",
    "html": "\n<p><strong>Tags:</strong> {tags}</p>",
}
ENDS = {"markdown": "\n\n---\n", "plain": "\n", "html": "\n</div>"}
DETAIL_ENDS = {"markdown": "", "plain": "", "html": "\n</div>"}
CLOSINGS = {"markdown": "", "plain": "", "html": "\n</div>"}
RULE = "=" * 50


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places as a concatenation of literals and columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        text, brace, rest = rest.partition("{")
        parts.append(F.lit(text))
        if brace:
            name, _, rest = rest.partition("}")
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def three_decimals(score: Column) -> Column:
    return F.format_string("%.3f", F.bround(score, 3))


def header(style: str, query: Column, count: Column) -> Column:
    none, one, many = (fill(t, query=query, count=count, rule=F.lit(RULE)) for t in HEADERS[style])
    return F.when(count == 0, none).when(count == 1, one).otherwise(many)


def item(style: str, details: bool = True) -> Column:
    """One result from the columns of a result record."""
    text = html_escape if style == "html" else (lambda column: F.coalesce(column, F.lit("")))
    out = fill(
        ITEMS[style],
        rank=F.col("rank"),
        title=text(F.col("title")),
        filename=text(F.col("filename")),
        path=text(F.col("path")),
        score=three_decimals(F.col("score")),
    )
    snippet = F.coalesce(F.col("content_snippet"), F.lit(""))
    preview = F.when(snippet != "", fill(PREVIEWS[style], snippet=text(snippet))).otherwise("")
    out = F.concat(out, preview)
    if details:
        tags = F.col("tags")
        if style == "html":
            tags = F.transform(
                tags, lambda tag: F.concat(F.lit("<span class='tag'>"), html_escape(tag), F.lit("</span>"))
            )
        shown = fill(
            DETAILS[style],
            size=file_size(F.col("size")),
            words=thousands(F.col("word_count")),
            modified=date_display(F.col("modified_time")),
        )
        tag_line = F.when(F.size("tags") > 0, fill(TAGS[style], tags=F.array_join(tags, ", "))).otherwise("")
        out = F.concat(out, shown, tag_line, F.lit(DETAIL_ENDS[style]))
    return F.concat(out, F.lit(ENDS[style]))
