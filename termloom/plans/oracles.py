"""The registered queries as SQL for DuckDB, written on their own, without the library."""

from __future__ import annotations

from termloom.functions.porter import STEP_2, STEP_3, STEP_4
from termloom.functions.render import RULE
from termloom.functions.wordlists import CUSTOM_STOP_WORDS, DEFAULT_FORMATS, ENGLISH_STOP_WORDS
from termloom.plans.registry import ALL_TERMS, FILTERS, MISSPELT, PATTERNS, PHRASES, PREFIX, TERMS

W = r"'[\p{L}\p{N}_]+'"
STRIP = r"'^\s+|\s+$', '', 'g'"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]"


def _values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else _quote(v) for v in row) + ")" for row in rows
    )


STOP = _list(ENGLISH_STOP_WORDS + CUSTOM_STOP_WORDS)


def _title(content: str, filename: str) -> str:
    first = rf"regexp_replace(regexp_extract({content}, '^\s*([^\n]*)', 1), {STRIP})"
    return (
        f"CASE WHEN length({first}) BETWEEN 1 AND 99 AND NOT ends_with({first}, '.') THEN {first} "
        rf"ELSE regexp_replace({filename}, '^(.+)\.[^./]+$', '\1') END"
    )


def _entities(text: str) -> str:
    # the references that occur in the pages; the ampersand last
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
                      ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")):
        text = f"replace({text}, {_quote(ref)}, {_quote(char)})"
    return text


def _html(html: str) -> str:
    for pattern in ("(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>",
                    "<[!?][^>]*>", "</?[a-zA-Z][^>]*>"):
        html = f"regexp_replace({html}, {_quote(pattern)}, '', 'g')"
    pieces = rf"string_split_regex({_entities(html)}, '\r\n|[\n\r]|  ')"
    return (
        f"array_to_string(list_filter(list_transform({pieces}, lambda s: regexp_replace(s, {STRIP})), "
        "lambda s: s <> ''), ' ')"
    )


def _markdown(text: str) -> str:
    """Of all marks, the documents hold bold and slanted words only; blocks lose the blank lines between them."""
    for stars in (r"\*\*", r"\*"):
        text = rf"regexp_replace({text}, '{stars}([^*\n]+){stars}', '\1', 'g')"
    return rf"regexp_replace(regexp_replace({text}, '\n\s*\n', chr(10), 'g'), {STRIP})"


def _markdown_page() -> str:
    """What a reader sees of a page that ``markdown_text`` makes of a document: its words without any mark."""
    lines = (
        "w[1], ' ', w[2]", _markdown("text"), "w[3], ' ', w[4], ' ', w[5]", "w[6], ' '", "w[3], ' ', w[4], ' ', w[5]",
        "w[6], ' https://b.example/', w[1]", "w[2], ' = 1'", "w[3]", "w[4], ' & <', w[5], '> '", "w[1]",
    )
    words = r"list_filter(string_split_regex(text, '[^\p{L}]+'), lambda x: x <> '')"
    page = "concat(" + ", chr(10), ".join(lines) + ")"
    return rf"""SELECT doc_id, sha256({page}) AS content_hash FROM (
      SELECT doc_id, text, {words} AS w FROM documents) WHERE len(w) >= 6"""


_SUFFIX = (
    "CASE source WHEN 'src0' THEN '.log' WHEN 'src1' THEN '.PDF' WHEN 'src2' THEN '.MD' "
    "WHEN 'src3' THEN '.Html' ELSE '.txt' END"
)
_BM25 = (
    "ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))"
)
_TFIDF = "tf * (ln(n_docs / (df + 1)) + 1)"
_WORD_OR_MARK = r"'[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'"
_GAPS = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'"
_FIELD_VALUE = r"'([\p{L}\p{N}_]+):(\S+)'"


def _marks(source: str, p: str = "") -> str:
    """Common tables that end in ``<p>marked``: rows with terms, content and title -> h_content and h_title."""
    return f"""{p}pieces AS (
  SELECT *, regexp_extract_all(content, {_GAPS}) AS ps, regexp_extract_all(title, {_GAPS}) AS ts FROM ({source})),
{p}found AS (
  SELECT *, list_position(list_transform(ps, lambda p: list_contains(terms, lower(p))), true) AS hit_at,
    list_position(list_transform(ts, lambda p: list_contains(terms, lower(p))), true) AS t_at FROM {p}pieces),
{p}cut AS (
  SELECT *,
    CASE WHEN hit_at > 0 THEN substring(content, greatest(1 + length(array_to_string(ps[1:hit_at - 1], '')) - 40, 1), 200) END AS frag,
    CASE WHEN t_at > 0 THEN substring(title, greatest(1 + length(array_to_string(ts[1:t_at - 1], '')) - 40, 1), 100) END AS t_frag
  FROM {p}found),
{p}marked AS (
  SELECT * EXCLUDE (ps, ts, hit_at, t_at),
    coalesce(array_to_string(list_transform(regexp_extract_all(frag, {_GAPS}),
      lambda p: CASE WHEN list_contains(terms, lower(p)) THEN '<b>' || p || '</b>' ELSE p END), ''),
      CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END) AS h_content,
    coalesce(array_to_string(list_transform(regexp_extract_all(t_frag, {_GAPS}),
      lambda p: CASE WHEN list_contains(terms, lower(p)) THEN '<b>' || p || '</b>' ELSE p END), ''), left(title, 100)) AS h_title
  FROM {p}cut)"""


PRELUDE = rf"""
WITH landing AS (
  SELECT *, regexp_extract(lower(filename), '^.+(\.[^./]+)$', 1) AS extension FROM (
    SELECT *, regexp_extract(path, '[^/]*$') AS filename FROM (
      SELECT concat('/landing/', source, '/', CASE WHEN lang = 'es' THEN '.' ELSE '' END, doc_id, {_SUFFIX}) AS path,
        strlen(text) AS size, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS modified_time, text AS content
      FROM documents))),
state AS (
  SELECT path, modified_time + CASE WHEN size > 1000 THEN INTERVAL 1 MINUTE ELSE -INTERVAL 1 MINUTE END AS indexed_time
  FROM landing WHERE extension <> '.md'),
corpus AS (
  SELECT concat(source, '/', doc_id, '.txt') AS path, concat(doc_id, '.txt') AS filename, '.txt' AS extension,
    strlen(text) AS size, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS modified_time, text AS content,
    [lang, source] AS tags, {_title("text", "concat(doc_id, '.txt')")} AS title,
    len(regexp_extract_all(text, {_WORD_OR_MARK})) AS word_count, len(string_split(text, chr(10))) AS line_count,
    length(text) AS char_count,
    len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\S'))) AS paragraph_count
  FROM documents WHERE regexp_matches(text, '\S')),
arrays AS (
  SELECT path, 'content' AS field, regexp_extract_all(lower(content), {W}) AS toks FROM corpus
  UNION ALL SELECT path, 'title', regexp_extract_all(lower(title), {W}) FROM corpus
  UNION ALL SELECT path, 'filename', regexp_extract_all(lower(filename), {W}) FROM corpus
  UNION ALL SELECT path, 'tags', tags FROM corpus),
tok AS (SELECT path, field, unnest(range(len(toks))) AS pos, unnest(toks) AS term FROM arrays),
lens AS (SELECT path, field, len(toks) AS doc_len FROM arrays),
postings AS (SELECT path, field, term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tok GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY ALL),
fs AS (SELECT field, count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens GROUP BY ALL),
batch_q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
all_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS w FROM benchmark),
six AS (
  SELECT item_id * 100000 + start AS id, w[start + 1:start + 6] AS w FROM (
    SELECT item_id, w, unnest(range(0, greatest(len(w) - 5, 1))) AS start FROM all_words WHERE len(w) > 0)),
mixed_q AS (
  SELECT id * 6 + unnest(range(6)) AS query_id, unnest([
    concat('"', w[1], ' ', w[2], '" filename:', w[3]), concat(w[2], '* ', w[3]),
    concat(w[1], ' AND ', w[2], ' title:', w[4], ' title:', w[5]), coalesce(w[4], ''),
    concat(' ', w[3], '  of ', w[5], ' ', w[6], '! '), concat(' ', chr(10), ' ')]) AS query
  FROM six),
any_q AS (
  SELECT * FROM mixed_q
  UNION ALL SELECT conv_id * 1000 + turn + 1000000000000, text FROM conversations),
texts AS (SELECT * FROM any_q UNION ALL SELECT -1 - query_id, query FROM batch_q),
parts AS (
  SELECT *, NOT regexp_matches(query, '\S') AS blank,
    regexp_replace(query, {STRIP}) AS original,
    regexp_extract_all(query, '"([^"]*)"', 1) AS phrases,
    regexp_extract_all(query, {_FIELD_VALUE}, 1) AS names, regexp_extract_all(query, {_FIELD_VALUE}, 2) AS vals,
    CASE WHEN regexp_matches(query, '\S')
      THEN regexp_replace(regexp_replace(query, '"[^"]*"', '', 'g'), {_FIELD_VALUE}, '', 'g') ELSE '' END AS residual
  FROM texts),
filters AS (
  SELECT query_id, name, arg_max(val, i) AS val FROM (
    SELECT query_id, unnest(names) AS name, unnest(vals) AS val, unnest(range(len(names))) AS i FROM parts WHERE NOT blank)
  GROUP BY ALL),
analysed AS (
  SELECT *, CASE WHEN regexp_matches(original, '"[^"]*"') THEN 'phrase'
      WHEN regexp_matches(original, '[*?]') THEN 'wildcard'
      WHEN regexp_matches(original, '(?i)(^|[^\p{{L}}\p{{N}}_])(AND|OR|NOT)([^\p{{L}}\p{{N}}_]|$)') THEN 'boolean'
      WHEN NOT blank AND NOT regexp_matches(original, '\s') THEN 'fuzzy' ELSE 'standard' END AS search_type,
    list_filter(regexp_extract_all(lower(residual), {W}),
      lambda t: length(t) BETWEEN 3 AND 50 AND NOT list_contains({STOP}, t)) AS terms
  FROM parts),
literal(query_id, term) AS (VALUES {_values([(q, t) for q, ts in TERMS.items() for t in ts])}),
hits AS (
  SELECT query_id, path, term, tf, doc_len, df, n_docs, avg_len
  FROM literal JOIN postings USING (term) JOIN dfs USING (field, term) JOIN fs USING (field) JOIN lens USING (path, field)
  WHERE field = 'content'),
bm AS (SELECT query_id, path, round(sum({_BM25}), 9) AS score FROM hits GROUP BY ALL),
bm_top AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank, path, score
  FROM bm QUALIFY rank <= 20),
batch_terms AS (
  SELECT DISTINCT -1 - query_id AS query_id, field, term FROM (
    SELECT query_id, unnest(terms) AS term FROM analysed WHERE query_id < 0),
    (SELECT unnest(['title', 'content', 'filename', 'tags']) AS field)),
batch_hits AS (
  SELECT query_id, path, tf, doc_len, df, n_docs, avg_len FROM batch_terms JOIN postings USING (field, term)
  JOIN dfs USING (field, term) JOIN fs USING (field) JOIN lens USING (path, field)),
batch_scored AS (SELECT query_id, path, round(sum({_BM25}), 9) AS score FROM batch_hits GROUP BY ALL),
ranked AS (
  SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank
  FROM batch_scored QUALIFY rank <= 20),
results AS (
  SELECT r.*, c.* EXCLUDE (path) FROM (SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ranked WHERE score >= 0.1) r
  JOIN corpus c USING (path)),
query_words AS (SELECT -1 - query_id AS query_id, list_distinct(terms) AS terms FROM analysed WHERE query_id < 0),
{_marks("SELECT r.*, q.terms FROM results r JOIN query_words q USING (query_id)")},
typed AS (
  SELECT * REPLACE (CASE regexp_extract(path, '^src([0-9])', 1) WHEN '0' THEN '.md' WHEN '2' THEN '.md' WHEN '1' THEN '.html'
    WHEN '5' THEN '' ELSE '.txt' END AS extension) FROM results),
type_counts AS (
  SELECT query_id, CASE WHEN extension = '' THEN 'unknown' ELSE extension END AS file_type, count(*) AS n,
    sum(score) AS s, min(rank) AS first_rank FROM typed GROUP BY ALL)
"""


def _ranks(order: str, source: str = "results") -> str:
    return (
        f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS rank, path "
        f"FROM {source}"
    )


_OUTCOME = f"""
SELECT path, CASE WHEN reason IS NULL THEN 'indexed' WHEN reason = 'unreadable' THEN 'error' ELSE 'skipped' END AS status,
  reason, CASE WHEN reason IS NULL THEN word_count END AS word_count,
  CASE WHEN reason = 'unreadable' THEN 'No such file or directory' END AS error FROM (
  SELECT path, CASE WHEN starts_with(filename, '.') THEN 'hidden'
    WHEN ends_with(filename, '.log') OR contains(path, '/src5/') THEN 'excluded'
    WHEN extension NOT IN {tuple(DEFAULT_FORMATS)} THEN 'unsupported'
    WHEN modified_time <= indexed_time THEN 'up_to_date'
    WHEN size > 4194 THEN 'too_large'
    WHEN size % 5 = 0 THEN 'unreadable'
    WHEN NOT regexp_matches(content, '\\S') THEN 'empty' END AS reason,
    len(regexp_extract_all(content, {_WORD_OR_MARK})) AS word_count
  FROM landing LEFT JOIN state USING (path))
"""

_DIFFERENT = "list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))"
# the byte distance is a cheap bound: it lets most pairs skip the exact test on characters
_ONE_EDIT = f"""CASE WHEN abs(length(a) - length(b)) > 1 OR damerau_levenshtein(a, b) > 8 THEN false ELSE (a = b
  OR (length(b) = length(a) + 1 AND len(list_filter(range(1, length(b) + 1),
      lambda i: left(b, i - 1) || substr(b, i + 1) = a)) > 0)
  OR (length(a) = length(b) + 1 AND len(list_filter(range(1, length(a) + 1),
      lambda i: left(a, i - 1) || substr(a, i + 1) = b)) > 0)
  OR (length(a) = length(b) AND (len({_DIFFERENT}) = 1 OR (len({_DIFFERENT}) = 2
      AND {_DIFFERENT}[2] = {_DIFFERENT}[1] + 1
      AND substr(a, {_DIFFERENT}[1], 1) = substr(b, {_DIFFERENT}[2], 1)
      AND substr(a, {_DIFFERENT}[2], 1) = substr(b, {_DIFFERENT}[1], 1))))) END"""


def _fuzzy(words: str, condition: str = "true") -> str:
    """(word, term) pairs over the content vocabulary."""
    return f"""SELECT a AS word, b AS term FROM {words},
      (SELECT DISTINCT term AS b FROM dfs WHERE field = 'content')
      WHERE {condition} AND {_ONE_EDIT}"""


_MISSPELT = f"(SELECT unnest({_list(MISSPELT)}) AS a)"
_PATTERN_PAIRS = f"""SELECT DISTINCT pattern, term FROM (SELECT unnest({_list(PATTERNS)}) AS pattern),
  (SELECT DISTINCT term FROM dfs WHERE field = 'content')
  WHERE term GLOB pattern"""

_PHRASE_SQL = " UNION ALL ".join(
    "SELECT CAST({id} AS BIGINT) AS phrase_id, t0.path, CAST(t0.pos AS INTEGER) AS start FROM tok t0 {joins} "
    "WHERE t0.field = 'content' AND t0.term = {first}".format(
        id=pid,
        first=_quote(text.split()[0]),
        joins=" ".join(
            f"JOIN tok t{i} ON t{i}.path = t0.path AND t{i}.field = 'content' AND t{i}.pos = t0.pos + {i} "
            f"AND t{i}.term = {_quote(word)}"
            for i, word in enumerate(text.split())
            if i
        ),
    )
    for pid, text in PHRASES
)

_MIXED_SCORED = f"""
, mixed AS (SELECT * FROM analysed WHERE query_id >= 0 AND query_id < 1000000000000 AND NOT blank
    AND (len(terms) > 0 OR len(phrases) > 0 OR len(names) > 0)),
all_fields AS (SELECT unnest(['title', 'content', 'filename', 'tags']) AS field),
wild AS (
  SELECT query_id, p FROM (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(residual), '[\\p{{L}}\\p{{N}}_*?]+'),
    lambda t: length(t) BETWEEN 3 AND 50 AND NOT list_contains({STOP}, t))) AS p FROM mixed WHERE search_type = 'wildcard')
  WHERE regexp_matches(p, '^[\\p{{L}}\\p{{N}}_]')),
content_terms AS (SELECT DISTINCT term AS b FROM dfs WHERE field = 'content'),
phrase_pairs AS (SELECT query_id, string_split(unnest(phrases), ' ') AS ws FROM mixed WHERE search_type = 'phrase'),
phrase_docs AS (
  SELECT DISTINCT query_id, t0.path FROM phrase_pairs JOIN tok t0 ON t0.term = ws[1] AND t0.field = 'content'
  JOIN tok t1 ON t1.path = t0.path AND t1.field = 'content' AND t1.pos = t0.pos + 1 AND t1.term = ws[2]),
misspelt AS (SELECT query_id, unnest(terms) AS a FROM mixed WHERE search_type = 'fuzzy'),
near_words AS (SELECT a, b FROM (SELECT DISTINCT a, left(a, 1) AS first FROM misspelt) JOIN
    (SELECT b, left(b, 1) AS first FROM content_terms) USING (first) WHERE {_ONE_EDIT}),
wild_words AS (SELECT p, b FROM (SELECT DISTINCT p FROM wild), content_terms WHERE b GLOB p),
plain_terms AS (
  SELECT query_id, field, term FROM
    (SELECT query_id, unnest(terms) AS term FROM mixed WHERE search_type NOT IN ('phrase', 'wildcard')), all_fields
  UNION SELECT query_id, name, unnest(regexp_extract_all(lower(val), {W})) FROM filters JOIN mixed USING (query_id)
    WHERE name IN ('title', 'content', 'filename')
  UNION SELECT query_id, 'content', b FROM wild JOIN wild_words USING (p)
  UNION SELECT query_id, 'content', b FROM misspelt JOIN near_words USING (a)),
phrase_terms AS (SELECT DISTINCT query_id, 'content' AS field, unnest(ws) AS term FROM phrase_pairs),
mixed_hits AS (
  SELECT query_id, path, field, term FROM plain_terms JOIN postings USING (field, term)
  UNION ALL SELECT query_id, path, field, term FROM phrase_terms JOIN postings USING (field, term)
    SEMI JOIN phrase_docs USING (query_id, path)),
-- the third kind of text asks for both words that AND joins, those that are no stop words
asked AS (
  SELECT DISTINCT id * 6 + 2 AS query_id, term FROM (SELECT id, unnest(w[1:2]) AS term FROM six)
  WHERE length(term) BETWEEN 3 AND 50 AND NOT list_contains({STOP}, term)),
held AS (SELECT query_id, path, count(DISTINCT term) AS n FROM asked JOIN postings USING (term) GROUP BY ALL),
allowed AS (
  SELECT query_id, path FROM held JOIN (SELECT query_id, count(*) AS n FROM asked GROUP BY ALL) USING (query_id, n)),
mixed_scored AS (
  SELECT query_id, path, round(sum({_BM25}), 9) AS score FROM
    (SELECT * FROM mixed_hits WHERE query_id % 6 <> 2 UNION ALL SELECT * FROM mixed_hits SEMI JOIN allowed USING (query_id, path)) JOIN postings USING (path, field, term)
  JOIN dfs USING (field, term) JOIN fs USING (field) JOIN lens USING (path, field) GROUP BY ALL)
"""
_MIXED = _MIXED_SCORED + """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank, path,
  round(score + 5e-10, 6) AS score FROM mixed_scored WHERE score >= 0.1 QUALIFY rank <= 20
"""

_BOOLEAN = f"""
, clause(query_id, clause, negated, term) AS (
  SELECT id * 5, unnest([0, 1, 2]), false, unnest(w[1:3]) FROM six
  UNION ALL SELECT id * 5 + 1, unnest([0, 0, 1]), false, unnest(w[1:3]) FROM six
  UNION ALL SELECT id * 5 + 2, unnest([0, 1]), unnest([true, false]), unnest(w[4:5]) FROM six
  UNION ALL SELECT id * 5 + 3, unnest([0, 1, 1]), false, unnest(w[4:6]) FROM six
  UNION ALL SELECT id * 5 + 4, unnest([0, 1, 2]), unnest([false, false, true]), unnest([w[6], w[5], w[1]]) FROM six),
asked AS (SELECT * FROM clause WHERE length(term) BETWEEN 3 AND 50 AND NOT list_contains({STOP}, term)),
met AS (SELECT DISTINCT query_id, clause, negated, field, term, path FROM asked JOIN postings USING (term)),
held AS (SELECT query_id, path, count(DISTINCT clause) AS n FROM met WHERE NOT negated GROUP BY ALL),
wanted AS (SELECT query_id, count(DISTINCT clause) AS n FROM asked WHERE NOT negated GROUP BY ALL),
good AS (
  SELECT query_id, path FROM held JOIN wanted USING (query_id, n)
  ANTI JOIN (SELECT query_id, path FROM met WHERE negated) USING (query_id, path)),
summed AS (
  SELECT query_id, path, round(sum({_BM25}), 9) AS score FROM
    (SELECT DISTINCT query_id, path, field, term FROM met WHERE NOT negated) SEMI JOIN good USING (query_id, path)
  JOIN postings USING (path, field, term) JOIN dfs USING (field, term) JOIN fs USING (field) JOIN lens USING (path, field)
  GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank, path,
  round(score, 6) AS score FROM summed WHERE score >= 0.1 QUALIFY rank <= 20
"""

_FILTER = (
    f"extension IN {FILTERS['file_types']} AND size <= {FILTERS['max_size']} "
    f"AND modified_time >= TIMESTAMP '{FILTERS['modified_after']}'"
)


def _size(size: str) -> str:
    unit = lambda power: f"({size} / {1024**power}.0)"
    def one(power, name):
        # exact: a value is a whole number of bytes over a power of two
        return f"printf('%.1f {name}', CAST({unit(power)} AS DOUBLE))"
    return (
        f"CASE WHEN {size} = 0 THEN '0 B' WHEN {size} < 1024 THEN {one(0, 'B')} WHEN {size} < 1048576 THEN {one(1, 'KB')} "
        f"WHEN {size} < 1073741824 THEN {one(2, 'MB')} WHEN {size} < 1099511627776 THEN {one(3, 'GB')} ELSE {one(4, 'TB')} END"
    )


def _escape(text: str) -> str:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {_quote(char)}, {_quote(ref)})"
    return text


def _render(header: tuple[str, str, str], item: str, closing: str = "''") -> str:
    none, one, many = header
    return f"""
, items AS (SELECT query_id, rank, {item} AS item FROM
    (SELECT *, left(h_content, 200) AS snippet FROM marked) WHERE rank <= 5),
lists AS (SELECT query_id, count(*) AS n, string_agg(chr(10) || item, '' ORDER BY rank) AS body FROM items GROUP BY ALL)
SELECT query_id, CASE WHEN n IS NULL THEN {none} WHEN n = 1 THEN {one} ELSE {many} END || coalesce(body, '') || {closing}
  AS response FROM batch_q LEFT JOIN lists USING (query_id)"""


_NL = "chr(10)"
_MARKDOWN_ITEM = (
    "concat('## ', rank, '. ', title, chr(10), '**File:** `', filename, '`', chr(10), '**Path:** `', path, '`', chr(10), "
    "'**Score:** ', printf('%.3f', score), CASE WHEN snippet <> '' THEN concat(chr(10), chr(10), '**Preview:**', chr(10), "
    "'> ', snippet) ELSE '' END, chr(10), chr(10), '**Details:**', chr(10), '- Size: ', "
    f"{_size('size')}, chr(10), '- Words: ', format('{{:,}}', word_count), chr(10), '- Modified: ', "
    "strftime(modified_time, '%Y-%m-%d %H:%M'), chr(10), '- Tags: ', array_to_string(tags, ', '), chr(10), chr(10), '---', chr(10))"
)
_PLAIN_ITEM = (
    "concat(rank, '. ', title, chr(10), '   File: ', filename, chr(10), '   Path: ', path, chr(10), '   Score: ', "
    "printf('%.3f', score), CASE WHEN snippet <> '' THEN concat(chr(10), '   Preview: ', snippet) ELSE '' END, chr(10))"
)
_HTML_ITEM = (
    "concat('<div class=''result-item'' data-rank=''', rank, '''>', chr(10), '<h2>', rank, '. ', "
    f"{_escape('title')}, '</h2>', chr(10), '<p><strong>File:</strong> <code>', {_escape('filename')}, '</code></p>', chr(10), "
    f"'<p><strong>Path:</strong> <code>', {_escape('path')}, '</code></p>', chr(10), '<p><strong>Score:</strong> ', "
    "printf('%.3f', score), '</p>', CASE WHEN snippet <> '' THEN concat(chr(10), "
    "'<div class=''preview''><strong>Preview:</strong></div>', chr(10), '<blockquote>', "
    f"{_escape('snippet')}, '</blockquote>') ELSE '' END, chr(10), '<div class=''details''>', chr(10), "
    f"'<p><strong>Size:</strong> ', {_size('size')}, '</p>', chr(10), '<p><strong>Words:</strong> ', "
    "format('{:,}', word_count), '</p>', chr(10), '<p><strong>Modified:</strong> ', "
    "strftime(modified_time, '%Y-%m-%d %H:%M'), '</p>', chr(10), '<p><strong>Tags:</strong> ', "
    f"array_to_string(list_transform(tags, lambda t: concat('<span class=''tag''>', {_escape('t')}, '</span>')), ', '), "
    "'</p>', chr(10), '</div>', chr(10), '</div>')"
)
_RECORD = (
    "{'title': title, 'filename': filename, 'path': path, 'score': round(score, 3), 'rank': rank, "
    "'content_snippet': left(h_content, 200), 'extension': extension, 'size': size, 'word_count': word_count, "
    "'modified_time': strftime(modified_time, '%Y-%m-%dT%H:%M:%S'), 'tags': tags, "
    "'highlights': {'content': h_content, 'title': h_title}, 'metadata': {'file_type': extension, "
    "'line_count': line_count, 'char_count': char_count, 'paragraph_count': paragraph_count, 'mime_type': 'text/plain'}}"
)


def _stems(source: str) -> str:
    """Common tables that end in ``stems`` (term, stem) of the words of a query; ``s`` is v or c for each character of ``w``."""
    shape = (
        "translate(replace(regexp_replace(translate(regexp_replace(w, '[^aeiouy]', 'c', 'g'), 'aeiou', 'vvvvv'), "
        r"'(^|v)y', '\1c', 'g'), 'yy', 'vc'), 'y', 'v')"
    )
    cut = lambda n: f"left(w, length(w) - {n})"
    rest = lambda n: f"left(s, length(s) - {n})"
    some, several = (lambda t: f"contains({t}, 'vc')"), (lambda t: f"regexp_matches({t}, 'vc.*vc')")
    short_end = lambda b, t: f"(ends_with({t}, 'cvc') AND NOT regexp_matches({b}, '[wxy]$'))"

    def table(rules: dict[str, str]) -> str:
        cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in rules.items())
        found = f"regexp_extract(w, '({'|'.join(rules)})$', 1)"
        n = f"length({found})"
        return f"CASE WHEN {n} > 0 AND {some(rest(n))} THEN {cut(n)} || CASE {found} {cases} END ELSE w END"

    cut_2, shape_2 = "left(w, length(w) - k)", "left(s, length(s) - k)"
    last = f"regexp_extract(w, '({'|'.join(STEP_4)})$', 1)"
    n = f"length({last})"
    steps = (
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 'ss') THEN w "
        f"WHEN ends_with(w, 's') THEN {cut(1)} ELSE w END",
        f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {some(rest(3))} THEN {cut(1)} ELSE w END
          WHEN k = 0 OR NOT contains({shape_2}, 'v') THEN w WHEN regexp_matches({cut_2}, '(at|bl|iz)$') THEN {cut_2} || 'e'
          WHEN length({cut_2}) > 1 AND ends_with({shape_2}, 'c') AND right({cut_2}, 1) = left(right({cut_2}, 2), 1)
            AND NOT regexp_matches({cut_2}, '[lsz]$') THEN left(w, length(w) - k - 1)
          WHEN {some(shape_2)} AND NOT {several(shape_2)} AND {short_end(cut_2, shape_2)} THEN {cut_2} || 'e' ELSE {cut_2} END""",
        f"CASE WHEN ends_with(w, 'y') AND contains({rest(1)}, 'v') THEN {cut(1)} || 'i' ELSE w END",
        table(STEP_2),
        table(STEP_3),
        f"CASE WHEN {n} > 0 AND {several(rest(n))} AND ({last} <> 'ion' OR regexp_matches({cut(n)}, '[st]$')) THEN {cut(n)} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({several(rest(1))} OR ({some(rest(1))} AND NOT {short_end(cut(1), rest(1))})) "
        f"THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {several('s')} THEN {cut(1)} ELSE w END",
    )
    out = f", stem_0 AS (SELECT DISTINCT term, term AS w FROM ({source}))"
    for i, step in enumerate(steps):
        suffix = "CASE WHEN ends_with(w, 'ed') THEN 2 WHEN ends_with(w, 'ing') THEN 3 ELSE 0 END"
        out += f", stem_{i + 1} AS (SELECT term, {step} AS w FROM (SELECT term, w, {shape} AS s, {suffix} AS k FROM stem_{i}))"
    return out + f", stems AS (SELECT term, CASE WHEN length(term) < 3 THEN term ELSE w END AS stem FROM stem_{len(steps)})"


_STEMMED_POSTINGS = """, stemmed AS (
  SELECT path, field, CASE WHEN field IN ('title', 'content') THEN stem ELSE term END AS term, count(*) AS tf,
    list(pos ORDER BY pos) AS positions FROM tok JOIN stems USING (term) GROUP BY ALL)"""

_STEMMED_SCORED = _stems("SELECT term FROM dfs UNION SELECT unnest(terms) FROM analysed WHERE query_id < 0") + _STEMMED_POSTINGS + f"""
      , s_dfs AS (SELECT field, term, count(*) AS df FROM stemmed GROUP BY ALL),
      s_terms AS (SELECT DISTINCT query_id, field, CASE WHEN field IN ('title', 'content') THEN stem ELSE term END AS term
        FROM batch_terms JOIN stems USING (term)),
      s_scored AS (SELECT query_id, path, round(sum({_BM25}), 9) AS score FROM s_terms JOIN stemmed USING (field, term)
        JOIN s_dfs USING (field, term) JOIN fs USING (field) JOIN lens USING (path, field) GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "hidden_file_filter": "SELECT path FROM landing WHERE NOT starts_with(filename, '.')",
    "exclude_globs": "SELECT path FROM landing WHERE NOT ends_with(filename, '.log') AND NOT contains(path, '/src5/')",
    "supported_extensions": f"SELECT path, extension FROM landing WHERE extension IN {tuple(DEFAULT_FORMATS)}",
    "size_cap": "SELECT path, size FROM landing WHERE size <= 4194",
    "blank_content_filter": r"SELECT path FROM landing WHERE contains(content, '.')",
    "incremental_filter": "SELECT path FROM landing LEFT JOIN state USING (path) "
    "WHERE indexed_time IS NULL OR modified_time > indexed_time",
    "upsert_by_path": """SELECT path, size, sha256(CASE WHEN size > 1000 THEN content || ' changed' ELSE content END) AS content_hash
      FROM landing UNION ALL SELECT concat(url, '/', page_id, '.html'), strlen(html), sha256(html) FROM pages""",
    "newest_version": "SELECT path, sha256(CASE WHEN length(content) > 1000 THEN content || ' changed' ELSE content END) "
    "AS content_hash FROM landing",
    "index_statistics": "SELECT count(*) AS document_count, 'content,content_hash,extension,filename,metadata,"
    "modified_time,path,size,tags,title,word_count' AS field_names, 'index' AS index_path, '1' AS schema_version FROM corpus",
    "ingest_status_rows": _OUTCOME,
    "ingest_report_counts": f"""SELECT count(*) AS total_files, count(*) FILTER (status = 'indexed') AS indexed_files,
      count(*) FILTER (status = 'skipped') AS skipped_files, count(*) FILTER (status = 'error') AS errors FROM ({_OUTCOME})""",
    "result_export": f"SELECT query_id, rank, CAST(to_json({_RECORD}) AS VARCHAR) AS json FROM marked WHERE rank <= 5",
    "extractor_routing": f"""SELECT path, sha256(CASE WHEN extension = '.html' THEN {_html('content')}
      WHEN extension = '.md' THEN {_markdown('content')} ELSE content END) AS content_hash FROM landing""",
    "text_decoding": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "text_decoding_utf16": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "html_text": f"SELECT page_id, {_html('html')} AS content FROM pages",
    "markdown_text": _markdown_page(),
    "corpus_scan": """SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
      'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS filename,
      '.parquet' AS extension""",
    "file_attributes": r"""SELECT path, filename, extension, size, regexp_replace(path, '/[^/]*$', '') AS parent,
      strftime(modified_time, '%Y-%m-%d %H:%M:%S') AS modified_time FROM landing""",
    "content_hashes": "SELECT path, sha256(content) AS content_hash FROM corpus",
    "word_counts": "SELECT path, word_count FROM corpus",
    "titles": "SELECT path, title FROM corpus",
    "page_titles": f"""SELECT path, {_title('content', 'filename')} AS title FROM (
      SELECT concat(url, '/', page_id, '.html') AS path, concat(page_id, '.html') AS filename, {_html('html')} AS content
      FROM pages)""",
    "line_counts": "SELECT path, line_count FROM corpus",
    "char_counts": "SELECT path, char_count FROM corpus",
    "paragraph_counts": "SELECT path, paragraph_count FROM corpus",
    "mime_types": """SELECT path, CASE extension WHEN '.txt' THEN 'text/plain' 
      WHEN '.pdf' THEN 'application/pdf' WHEN '.md' THEN 'text/markdown' WHEN '.html' THEN 'text/html' END AS mime_type
      FROM landing""",
    "metadata_records": """SELECT path, CAST(to_json({'file_type': extension, 'line_count': line_count,
      'char_count': char_count, 'paragraph_count': paragraph_count, 'mime_type': 'text/plain'}) AS VARCHAR) AS metadata
      FROM corpus""",
    "entity_tags": r"""
      , sentences AS (SELECT unnest(string_split_regex(text, '[.\n]\s*')) AS sentence FROM benchmark),
      named AS (SELECT DISTINCT regexp_extract(sentence, '^(\p{L}+ \p{L}+)', 1) AS entity FROM sentences
        WHERE length(sentence) <= 60 AND regexp_matches(sentence, '^\p{L}+ \p{L}+')),
      spaced AS (SELECT path, ' ' || array_to_string(toks, ' ') || ' ' AS line FROM arrays WHERE field = 'content')
      SELECT path, string_agg(entity, '|' ORDER BY entity) AS tags FROM spaced, named
      WHERE contains(line, ' ' || lower(entity) || ' ') GROUP BY path""",
    "token_positions": "SELECT path, CAST(pos AS INTEGER) AS pos, term FROM tok WHERE field = 'content'",
    "term_length_filter": "SELECT term, df FROM dfs WHERE field = 'content' AND length(term) BETWEEN 3 AND 50",
    "stop_word_filter": f"SELECT term, df FROM dfs WHERE field = 'content' AND NOT list_contains({STOP}, term)",
    "punctuation_filter": f"""SELECT term, count(*) AS n FROM
      (SELECT unnest(regexp_extract_all(lower(text), {W})) AS term FROM documents) GROUP BY term""",
    "postings": "SELECT path, field, term, tf, array_to_string(positions, ',') AS positions FROM postings "
    "WHERE field = 'content'",
    "field_analyzers": "SELECT path, field, term, tf FROM postings WHERE field <> 'content'",
    "term_statistics": "SELECT field, term, df, cf FROM dfs WHERE field = 'content'",
    "field_statistics": "SELECT field, n_docs, round(avg_len, 6) AS avg_len FROM fs",
    "document_lengths": "SELECT path, field, doc_len FROM lens",
    "term_match": "SELECT path, tf FROM postings WHERE field = 'content' AND term = 'thtion'",
    "any_of_multi_field": "SELECT DISTINCT CAST(query_id AS BIGINT) AS query_id, path FROM literal JOIN postings USING (term)",
    "any_of_content": "SELECT DISTINCT CAST(query_id AS BIGINT) AS query_id, path FROM hits",
    "all_of": f"""
      , wanted(query_id, term) AS (VALUES {_values([(q, t) for q, ts in ALL_TERMS.items() for t in ts])})
      SELECT CAST(query_id AS BIGINT) AS query_id, path FROM
        (SELECT query_id, path, count(DISTINCT term) AS n FROM wanted JOIN postings USING (term) GROUP BY ALL)
        JOIN (SELECT query_id, count(*) AS n FROM wanted GROUP BY ALL) USING (query_id, n)""",
    "none_of": "SELECT path FROM corpus WHERE path NOT IN (SELECT path FROM postings WHERE field = 'content' "
    "AND term IN ('the', 'of'))",
    "nested_boolean": """SELECT CAST(1 AS BIGINT) AS query_id, path FROM postings WHERE field = 'content' GROUP BY path
      HAVING bool_or(term = 'that') AND bool_or(term IN ('thtion', 'tionand')) AND NOT bool_or(term = 'und')""",
    "phrase_match": _PHRASE_SQL,
    "wildcard_expansion": _PATTERN_PAIRS,
    "wildcard_match": f"SELECT DISTINCT pattern, path FROM ({_PATTERN_PAIRS}) JOIN postings USING (term) WHERE field = 'content'",
    "fuzzy_expansion": _fuzzy(_MISSPELT),
    "fuzzy_expansion_same_start": _fuzzy(_MISSPELT, "left(a, 1) = left(b, 1)"),
    "fuzzy_match": f"SELECT DISTINCT word, path FROM ({_fuzzy(_MISSPELT)}) JOIN postings USING (term) WHERE field = 'content'",
    "field_scoped_term": """SELECT CAST(query_id AS BIGINT) AS query_id, field, term, path
      FROM (VALUES (1, 'fr'), (1, '12'), (2, 'src3'), (2, 'txt')) q(query_id, term) JOIN postings USING (term)
      WHERE field IN ('filename', 'tags')""",
    "bm25_scores": "SELECT CAST(query_id AS BIGINT) AS query_id, path, round(score, 6) AS score FROM bm",
    "tfidf_scores": f"SELECT CAST(query_id AS BIGINT) AS query_id, path, round(sum({_TFIDF}), 6) AS score FROM hits GROUP BY ALL",
    "minimum_score": "SELECT CAST(query_id AS BIGINT) AS query_id, rank, path, round(score, 6) AS score FROM bm_top "
    "WHERE score >= 2.0",
    "top_k": "SELECT CAST(query_id AS BIGINT) AS query_id, rank, path, round(score, 6) AS score FROM bm_top",
    "top_k_single": "SELECT CAST(query_id AS BIGINT) AS query_id, rank, path, round(score, 6) AS score FROM bm_top "
    "WHERE query_id = 1",
    "filters_after_top_k": f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)
      AS INTEGER) AS rank, path, round(score, 6) AS score FROM results WHERE {_FILTER}""",
    "filters_before_top_k": f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)
      AS INTEGER) AS rank, path, round(score, 6) AS score FROM batch_scored JOIN corpus USING (path)
      WHERE score >= 0.1 AND {_FILTER} QUALIFY rank <= 20""",
    "sort_by_filename": _ranks("lower(filename) DESC, rank"),
    "sort_by_size_ascending": _ranks("size, rank"),
    "sort_by_modified_time": _ranks("modified_time DESC, rank"),
    "sort_by_word_count": _ranks("word_count DESC, rank"),
    "sort_by_unknown_key": "SELECT query_id, rank, path FROM results",
    "highlights": "SELECT query_id, rank, path, h_content AS content, h_title AS title, left(h_content, 200) AS "
    "content_snippet FROM marked",
    "highlights_expanded": _MIXED_SCORED + """
      , x_top AS (SELECT query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank
        FROM mixed_scored WHERE query_id % 6 IN (1, 3) AND score >= 0.1 QUALIFY rank <= 20),
      x_terms AS (SELECT query_id, path, list(DISTINCT term) AS terms FROM mixed_hits GROUP BY ALL), """
    + _marks("SELECT x_top.*, content, title, terms FROM x_top JOIN x_terms USING (query_id, path) JOIN corpus USING (path)", "x_")
    + " SELECT query_id, rank, path, h_content AS content, h_title AS title, left(h_content, 200) AS content_snippet FROM x_marked",
    "highlights_stemmed": _STEMMED_SCORED + """
      , x_top AS (SELECT query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank
        FROM s_scored WHERE score >= 0.1 QUALIFY rank <= 20),
      x_matched AS (SELECT DISTINCT query_id, path, term AS m FROM x_top JOIN stemmed USING (path) JOIN s_terms USING (query_id, field, term)),
      x_words AS (SELECT DISTINCT query_id, path, term AS w, stem FROM x_top JOIN tok USING (path) JOIN stems USING (term)
        WHERE field IN ('content', 'title')),
      x_terms AS (SELECT query_id, path, list(DISTINCT w) AS terms FROM x_words JOIN x_matched USING (query_id, path)
        WHERE m = w OR m = stem GROUP BY ALL), """
    + _marks("SELECT x_top.*, content, title, coalesce(terms, []) AS terms FROM x_top LEFT JOIN x_terms USING (query_id, path) "
             "JOIN corpus USING (path)", "x_")
    + " SELECT query_id, rank, path, h_content AS content, h_title AS title, left(h_content, 200) AS content_snippet FROM x_marked",
    "plain_snippets": "SELECT path, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END "
    "AS snippet, left(title, 100) AS title FROM corpus",
    "result_records": """SELECT query_id, rank, round(score, 6) AS score, path, filename, title, extension, size, word_count,
      strftime(modified_time, '%Y-%m-%d %H:%M:%S') AS modified_time, array_to_string(tags, ',') AS tags, line_count
      FROM results""",
    "valid_queries": """SELECT query_id, query FROM analysed WHERE query_id >= 0 AND NOT blank AND length(original) <= 150
      AND (len(terms) > 0 OR len(phrases) > 0 OR len(names) > 0)""",
    "suggestions": f"""SELECT DISTINCT term AS suggestion FROM (SELECT field, term FROM dfs
      WHERE field IN ('title', 'content', 'filename') AND starts_with(term, '{PREFIX}')
      QUALIFY row_number() OVER (PARTITION BY field ORDER BY term) <= 5) ORDER BY suggestion LIMIT 5""",
    "flagship_search": """SELECT CAST(query_id AS BIGINT) AS query_id, rank, round(score, 6) AS score, path, title, word_count
      FROM bm_top JOIN corpus USING (path) WHERE query_id = 1""",
    "batch_search": "SELECT query_id, rank, path, round(score, 6) AS score FROM results",
    "stored_search": "SELECT query_id, rank, path, round(score, 6) AS score FROM results",
    "stored_wildcards": f"{_PATTERN_PAIRS} UNION ALL SELECT word, term FROM ({_fuzzy(_MISSPELT)})",
    "batch_search_tfidf": f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)
      AS INTEGER) AS rank, path, round(score, 6) AS score FROM
      (SELECT query_id, path, round(sum({_TFIDF}), 9) AS score FROM batch_hits GROUP BY ALL)
      WHERE score >= 0.1 QUALIFY rank <= 20""",
    "batch_search_all_kinds": _MIXED,
    "batch_search_boolean": _BOOLEAN,
    "query_phrases": "SELECT query_id, array_to_string(phrases, '|') AS phrases FROM parts "
    "WHERE query_id >= 0 AND query_id < 1000000000000",
    "query_filters": """SELECT query_id, coalesce(f, '') AS filters FROM mixed_q LEFT JOIN (SELECT query_id,
      string_agg(name || '=' || val, '|' ORDER BY name) AS f FROM filters GROUP BY query_id) USING (query_id)""",
    "query_residuals": "SELECT query_id, residual FROM parts WHERE query_id >= 0 AND query_id < 1000000000000",
    "query_types": "SELECT query_id, search_type FROM analysed WHERE query_id >= 0",
    "query_terms": "SELECT query_id, array_to_string(terms, '|') AS terms FROM analysed WHERE query_id >= 0",
    "analyzed_queries": rf"""SELECT query_id, CASE WHEN blank THEN '' ELSE original END AS original,
      CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' ') ELSE regexp_replace(residual, {STRIP}) END AS processed,
      search_type, CAST(len(terms) AS INTEGER) AS n_terms, CAST(len(phrases) AS INTEGER) AS n_phrases
      FROM analysed WHERE query_id >= 0 AND query_id < 1000000000000""",
    "stemmed_vocabulary": _stems("SELECT term FROM dfs WHERE field = 'content'") + " SELECT term, stem FROM stems",
    "stemmed_postings": _stems("SELECT term FROM dfs") + _STEMMED_POSTINGS
    + " SELECT path, field, term, tf, array_to_string(positions, ',') AS positions FROM stemmed",
    "query_terms_stemmed": _stems("SELECT unnest(terms) AS term FROM analysed WHERE query_id >= 0") + rf"""
      , places AS (SELECT query_id, unnest(terms) AS term, unnest(range(len(terms))) AS i FROM analysed WHERE query_id >= 0),
      joined AS (SELECT query_id, list(stem ORDER BY i) AS found FROM places JOIN stems USING (term) GROUP BY query_id)
      SELECT query_id, coalesce(array_to_string(found, '|'), '') AS terms,
        CASE WHEN found IS NOT NULL THEN array_to_string(found, ' ') ELSE regexp_replace(residual, {STRIP}) END AS processed
      FROM analysed LEFT JOIN joined USING (query_id) WHERE query_id >= 0""",
    "batch_search_stemmed": _STEMMED_SCORED + """
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS rank, path,
        round(score, 6) AS score FROM s_scored WHERE score >= 0.1 QUALIFY rank <= 20""",
    "log_retention": """SELECT event_id AS query_id, event_type AS query,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_results FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000""",
    "log_statistics": """SELECT count(*) AS total_searches, round(avg(value), 6) AS average_search_time,
      round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS average_results_per_search FROM events""",
    "log_recent_queries": """SELECT string_agg(event_type, ',' ORDER BY ts, event_id) AS recent_queries FROM
      (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)""",
    "log_records": """SELECT query_id, query, coalesce(n, 0) AS total_results, CAST(0.25 AS DOUBLE) AS search_time FROM batch_q
      LEFT JOIN (SELECT query_id, count(*) AS n FROM results GROUP BY query_id) USING (query_id)""",
    "result_statistics": """SELECT query_id, CAST(sum(n) AS BIGINT) AS total_results, round(sum(s) / sum(n), 3) AS average_score,
      string_agg(file_type || '=' || n, ',' ORDER BY file_type) AS file_types FROM type_counts GROUP BY query_id""",
    "summary_lines": """SELECT query_id, CASE WHEN total IS NULL THEN concat('No results found for ''', query, ''' in 0.50s')
      ELSE concat('Found ', total, ' documents for ''', query, ''' in 0.50s. Top file types: ', types) END AS summary
      FROM batch_q LEFT JOIN (
        SELECT query_id, CAST(any_value(total) AS BIGINT) AS total, string_agg(n || ' ' || file_type, ', ' ORDER BY place) AS types FROM (
          SELECT *, sum(n) OVER (PARTITION BY query_id) AS total,
            row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first_rank) AS place FROM type_counts)
        WHERE place <= 3 GROUP BY query_id) USING (query_id)""",
    "related_directories": r"""SELECT query_id, array_to_string(list_transform(list_sort(list(DISTINCT
      regexp_replace(path, '/[^/]*$', '')))[1:3], lambda d: 'Explore more files in: ' || d), '|') AS directories
      FROM results GROUP BY query_id""",
    "rendered_markdown": _render(
        (
            "concat('# No Results Found', chr(10), chr(10), 'Sorry, no documents were found matching **''', query, '''**.', chr(10))",
            "concat('# 1 Document Found', chr(10), chr(10), 'Found 1 document matching **''', query, '''**:', chr(10))",
            "concat('# ', n, ' Documents Found', chr(10), chr(10), 'Found ', n, ' documents matching **''', query, '''**:', chr(10))",
        ),
        _MARKDOWN_ITEM,
    ),
    "rendered_plain": _render(
        (
            f"concat('NO RESULTS FOUND', chr(10), '{RULE}', chr(10), 'Sorry, no documents were found matching ''', query, '''.', chr(10))",
            f"concat('1 DOCUMENT FOUND', chr(10), '{RULE}', chr(10), 'Found 1 document matching ''', query, ''':', chr(10))",
            f"concat(n, ' DOCUMENTS FOUND', chr(10), '{RULE}', chr(10), 'Found ', n, ' documents matching ''', query, ''':', chr(10))",
        ),
        _PLAIN_ITEM,
    ),
    "rendered_html": _render(
        (
            "concat('<h1>No Results Found</h1>', chr(10), '<p>Sorry, no documents were found matching <strong>''', query, "
            "'''</strong>.</p>', chr(10), '<div class=''search-results''>')",
            "concat('<h1>1 Document Found</h1>', chr(10), '<p>Found 1 document matching <strong>''', query, "
            "'''</strong>:</p>', chr(10), '<div class=''search-results''>')",
            "concat('<h1>', n, ' Documents Found</h1>', chr(10), '<p>Found ', n, ' documents matching <strong>''', query, "
            "'''</strong>:</p>', chr(10), '<div class=''search-results''>')",
        ),
        _HTML_ITEM,
        "chr(10) || '</div>'",
    ),
    "rendered_json": f"""
      , lists AS (SELECT query_id, list({_RECORD} ORDER BY rank) AS rs FROM marked WHERE rank <= 5 GROUP BY query_id)
      SELECT query_id, concat('{{"query":', to_json(query), ',"total_results":', coalesce(len(rs), 0), ',"results":',
        coalesce(to_json(rs), '[]'), '}}') AS response FROM batch_q LEFT JOIN lists USING (query_id)""",
    "file_sizes": f"""SELECT path, {_size('(size % 900)')} AS bytes, {_size('size')} AS size, {_size('(size * 3001)')} AS large,
      {_size('(size * 5000011111)')} AS huge FROM landing""",
    "date_displays": """SELECT event_id, CASE event_id % 9 WHEN 2 THEN strftime(ts, '%Y') WHEN 3 THEN strftime(ts, '%Y-%m-%d 00:00')
      WHEN 5 THEN strftime(ts, '%H:%M:%S') WHEN 7 THEN 'Unknown' WHEN 8 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown
      FROM events""",
    "html_escaping": f"SELECT page_id, {_escape('html')} AS escaped FROM pages",
    "content_previews": """SELECT path, CASE WHEN size > 20000 THEN 'File too large to preview'
      ELSE concat('```', chr(10), array_to_string(ls[1:least(n, 10)], chr(10)),
        CASE WHEN n > 10 OR ends_with(content, chr(10)) THEN chr(10) ELSE '' END,
        CASE WHEN n > 10 THEN concat(chr(10), '... (', n - 10, ' more lines)') ELSE '' END, chr(10), '```') END AS preview
      FROM (SELECT path, size, content, string_split(content, chr(10)) AS ls,
        line_count - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END AS n FROM corpus)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: PRELUDE + sql for name, sql in ORACLES.items()}
