"""Column helpers on single values, against plain Python where it has the same function."""

import fnmatch
import html

import pytest
from pyspark.sql import functions as F

from termloom.functions import document, extract, querytext, text
from termloom.functions.snippet import highlight, plain_snippet, term_regex


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_html_keeps_text_only(spark):
    page = (
        "<!DOCTYPE html><html><head><title>My  page</title><style>p{a:b}</style>"
        '<script>var t="</p>"; if (a<b) x();</script></head><body><!-- no -->'
        '<ul><li>a</li><li>b</li></ul>\n <p title="x>y">One &amp;lt; two &copy; &#233;&#x41; 1 < 2</p>\r\n</body></html>'
    )
    assert one(spark, extract.html_to_text, page) == ["My page ab One &lt; two © éA 1 < 2".replace("My page ab", "My pageab")]


def test_html_chunks_split_at_two_blanks(spark):
    assert one(spark, extract.html_to_text, "<p>a  b   c d</p>\n\n  <p>e</p>") == ["a b c d e"]


def test_html_broken_markup_ends(spark):
    assert one(spark, extract.html_to_text, "<p>x<a href='" + "y" * 5000) == ["x<a href='" + "y" * 5000]
    assert one(spark, extract.html_to_text, "a<script>never closed") == ["a"]


def test_entities_are_decoded_once(spark):
    texts = ["&amp;amp;", "&lt;b&gt;", "no entity", "&unknown; &", "&#128;&#38;#38;", "&#x1F31F;", "&eacute;t&eacute;"]
    expected = [html.unescape(t) for t in texts]
    expected[4] = "\x80&#38;"  # a bare code point, without the table for old Windows pages
    assert one(spark, extract.decode_entities, *texts) == expected


def test_markdown(spark):
    source = (
        "# Web Development\nBuilding *modern* **web** applications\n\nSee [the guide](http://x.y) and ![logo](l.png)`code`\n"
        "\n- one\n- two\n\n> quoted\n\n```\nraw\n```\n***\nsnake_case_name 1 * 2"
    )
    assert one(spark, extract.markdown_to_text, source) == [
        "Web Development\nBuilding modern web applications\nSee the guide and code\none\ntwo\nquoted\nraw\nsnake_case_name 1 * 2"
    ]


def test_decode_drops_bad_bytes(spark):
    rows = spark.createDataFrame([(bytearray(b"ab\xffc \xe4\xbd\xa0\xf0\x9f\x8c"),)], "raw binary")
    assert rows.select(extract.decode_text(F.col("raw"))).first()[0] == "abc 你"
    for encoding, text, left in (("latin-1", "café", ""), ("utf-16-le", "a你", "61"), ("ascii", "abc", "E9"), ("UTF-32", "x🌟", "")):
        raw = spark.sql(f"SELECT unhex('{text.encode(encoding).hex()}{left}') AS raw")
        name = {"utf-16-le": "UTF-16LE"}.get(encoding, encoding)
        assert raw.select(extract.decode_text(F.col("raw"), name)).first()[0] == text


@pytest.mark.parametrize("pattern", ["*.pyc", "node_modules", "a?c", "[ab]*.log", "[!a]x", "*/tmp/*", "a.b", "x[1", "a+(b)"])
def test_globs(spark, pattern):
    names = ["m.pyc", "node_modules", "abc", "a.log", "b1.log", "bx", "ax", "/u/tmp/f", "aXb", "a.b", "x[1", "a+(b)", "a\nb.pyc"]
    got = one(spark, lambda v: text.matches_any(v, (pattern,)), *names)
    assert got == [fnmatch.fnmatchcase(n, pattern) for n in names]


def test_file_sizes_round_like_python(spark):
    def expected(size):
        if size == 0:
            return "0 B"
        for unit in ["B", "KB", "MB", "GB"]:
            if size < 1024:
                return f"{size:.1f} {unit}"
            size /= 1024
        return f"{size:.1f} TB"

    sizes = [0, 1, 1023, 1024, 1088, 1152, 1280, 1331, 1536, 1024**2 - 1, 1024**2 * 5 // 4, 10**9, 10**12, 3 * 10**13]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i long, s long").orderBy("i")
    assert [r[0] for r in rows.select(text.file_size(F.col("s"))).collect()] == [expected(s) for s in sizes]


def test_dates(spark):
    assert one(spark, text.date_display, "2024-03-01T10:11:12", "2024-03-01", "", None, "soon") == [
        "2024-03-01 10:11", "2024-03-01 00:00", "Unknown", "Unknown", "soon",
    ]
    assert one(spark, text.date_display, "2024", "12:30", "2024-03-01T10:00:00+02:00", "2024-03-01 09:08:07.5Z", "2024-13-01") == [
        "2024", "12:30", "2024-03-01 10:00", "2024-03-01 09:08", "2024-13-01",
    ]


def test_preview(spark):
    lines = "\n".join(f"l{i}" for i in range(12))
    got = one(spark, lambda v: text.content_preview(v, F.length(v), 10), lines, "a\nb", "a\nb\n", "")
    assert got == [
        "```\n" + "\n".join(f"l{i}" for i in range(10)) + "\n\n... (2 more lines)\n```",
        "```\na\nb\n```", "```\na\nb\n\n```", "```\n\n```",
    ]


def test_titles(spark):
    values = ["  My title  \nrest", "A sentence.\nmore", "", "x" * 100, "x" * 99, "\n\n ok \n"]
    got = one(spark, lambda v: document.title(v, F.lit("a.tar.gz")), *values)
    assert got == ["My title", "a.tar", "a.tar", "a.tar", "x" * 99, "ok"]


def test_names(spark):
    paths = ["/a/b/c.TXT", "x.tar.gz", "/a/.hidden", "noext", "/r.md"]
    assert one(spark, lambda v: document.extension(document.filename(v)), *paths) == [".txt", ".gz", "", "", ".md"]
    assert one(spark, document.parent, *paths) == ["/a/b", ".", "/a", ".", "/"]


def test_counts_are_in_code_points(spark):
    assert one(spark, document.char_count, "🌟 café") == [6]
    assert one(spark, document.paragraph_count, "a\n\n \n\nb\n\n\nc") == [3]
    assert one(spark, document.word_count, "Don't stop, now!") == [7]


def test_query_analysis(spark):
    queries = ['say "big data" now title:a title:b', "pyth*", "cats and dogs", "word", "two words", "  ", 'a:b "c:d"']
    assert one(spark, querytext.search_type, *queries) == [
        "phrase", "wildcard", "boolean", "fuzzy", "standard", "standard", "phrase",
    ]
    assert one(spark, querytext.phrases, queries[0], queries[5]) == [["big data"], []]
    assert one(spark, querytext.filters, queries[0], queries[5], queries[6]) == [{"title": "b"}, {}, {"a": "b", "c": 'd"'}]
    assert one(spark, querytext.terms, queries[0], queries[2]) == [["say"], ["cats", "dogs"]]
    got = one(spark, querytext.patterns, "pyth*n *tion th?s", "what is python?", "python?")
    assert got == [["pyth*n", "th?s"], ["python"], ["python?"]]


def test_highlight(spark):
    regex = term_regex(F.array(F.lit("python"), F.lit("dat*")))
    got = one(spark, lambda v: highlight(v, regex, 60), "Python, python-data pythons", "nothing", "x " * 50 + "database")
    assert got[0] == "<b>Python</b>, <b>python</b>-<b>data</b> pythons"
    assert got[1] is None
    assert got[2] == ("x " * 20 + "<b>database</b>")
    assert one(spark, lambda v: plain_snippet(v, 5), "abcdef", "abcde") == ["abcde...", "abcde"]


def test_squeezed_texts_have_no_white_space_in_a_row(spark):
    from termloom.llm.token_counts import squeezed

    values = ["", None, " ", "a b", "a  b", "\ta\r\n\n b \t", "x\u00a0\u00a0y\x0b\x0bz", "a\nb", "     ", "a \n b   c"]
    whole = one(spark, lambda v: F.regexp_replace(v, "[ \\t\\n\\r]+", " "), *values)
    assert one(spark, squeezed, *values) == whole
    # single blanks, which most texts are full of, aren't replaced by themselves
    plan = spark.createDataFrame([("a b",)], "v string").select(squeezed(F.col("v")))._jdf.queryExecution().toString()
    assert "{2,}" in plan and "]+" not in plan
