"""Secret scans: credential patterns, and weak parts of credentials linked by an interval join.

Some matches are secrets by themselves (``assign``, ``access``, ``hex``). Others are weak: a login, a long
mixed token, an endpoint. A weak part counts only when complementary parts lie in its scope, at most
``SCOPE`` characters away or overlapping it (a URL holds its parameters): an identifier needs a secret, a secret
needs an identifier, an endpoint needs both. An endpoint that has both links them, however far they are from each
other: a login before it and a token behind it count as well. A passcode ends where ``&name=`` begins another parameter.

Positions are code points. They come from the lengths of the matches and of the gaps between them, added up
over the matches of a text. Everything is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.scratch import stored

#: Most characters between two parts of one credential.
SCOPE = 200
REDACTED = "[redacted]"

# The patterns of the base kinds, their least sizes, and the order of kinds.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{32,}"}
#: Kinds that need a complement.
WEAK = {
    "login": r"""(?i)\b(user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""",
    "passcode": r"""(?i)\b(pwd|passphrase|passcode|pin|secret_?key|private_?key)["']?\x20*[:=]\x20*["']?((?:[^\s"',;&]++|&(?!\w+=))++)""",
    "mixed": r"[A-Za-z0-9+/]{32,}={0,2}",
    "endpoint": r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b",
}
KINDS = (*BASE, *WEAK)
_IDENTIFIERS, _SECRETS = ("access", "login"), ("assign", "hex", "passcode", "mixed")


def _found(text: Column) -> Column:
    """The kinds with a match: (kind, lengths of the gaps before the matches, matches)."""
    parts = []
    for kind, pattern in (BASE | WEAK).items():
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.when(text.rlike(pattern), F.split(text, pattern, -1))
        parts.append(F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), F.when(gaps.isNotNull(), hits).alias("hits")))
    return F.filter(F.array(*parts), lambda p: p["gaps"].isNotNull())


def _kept(kind: Column, hit: Column) -> Column:
    """Whether a match of a kind is one: long enough, and mixed where the kind asks for it."""
    value = F.regexp_extract(hit, _ASSIGN, 2)
    mixed = hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")
    return (
        F.when(kind == "assign", F.length(value) >= 8)
        .when(kind == "access", F.length(hit) >= 16)
        .when(kind == "mixed", mixed)
        .otherwise(True)
    )


def parts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, copies) of the documents and (row, kind, start, end) of all matches, weak ones too.

    ``row`` is a hash of id and text: repeated rows are one row with so many copies.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), content).alias("row"), content.alias("text")
    )
    # the document itself is a part without a kind, so that one pass gives both
    itself = F.array(F.struct(F.lit("").alias("kind"), F.array(F.lit("")).alias("gaps"), F.array(F.lit("")).alias("hits")))
    pieces = texts.select("doc_id", "row", F.explode(F.concat(itself, _found(F.col("text")))).alias("p")).select(
        "doc_id", "row", F.col("p.kind").alias("kind"), F.posexplode(F.arrays_zip("p.hits", "p.gaps")).alias("place", "m")
    )
    # the gap after the last match has no match and goes
    matches = (
        pieces.filter("m.hits IS NOT NULL")
        .select(
            "doc_id", "row", "kind", "place", F.length("m.gaps").alias("gap"), F.length("m.hits").alias("size"),
            _kept(F.col("kind"), F.col("m.hits")).alias("kept"),
        )
        .groupBy("doc_id", "row", "kind", "place", "gap", "size", "kept")
        .agg(F.count("*").alias("copies"))
    )
    so_far = Window.partitionBy("doc_id", "row", "kind").orderBy("place")
    # short rows, stored so that the texts are read once
    placed = stored(matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("long")), "parts")
    rows = placed.filter("kind = ''").select("doc_id", "row", "copies")
    spans = placed.filter("kind <> '' AND kept").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    return rows, spans


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``left`` with a row of ``right`` in the same text that overlaps them or lies within the scope.

    Both are keyed by the stretches of the text that they cover, the left ones also by those on either side: an
    equi-join that meets only parts that lie near each other. No kind is on both sides, so no part meets itself.
    """
    stretch = lambda c: F.floor(F.col(c) / SCOPE)
    l = left.withColumn("s", F.explode(F.sequence(stretch("start") - 1, stretch("end") + 1))).alias("l")
    r = right.select(
        "row", F.col("start").alias("start2"), F.col("end").alias("end2"), F.explode(F.sequence(stretch("start"), stretch("end"))).alias("s")
    ).alias("r")
    near = (F.col("start2") <= F.col("end") + SCOPE) & (F.col("end2") >= F.col("start") - SCOPE)
    met = l.join(r, (F.col("l.row") == F.col("r.row")) & (F.col("l.s") == F.col("r.s")) & near, "left_semi")
    return met.select("row", "kind", "start", "end").distinct()


def secrets(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, copies, spans) with spans as a sorted array of (start, rank of the kind, end, kind).

    ``row`` tells different texts of one id apart; ``copies`` counts repeated rows. A null text is an empty one
    and has no spans; null ids are kept as such; other columns are ignored; no documents give no rows. Spans of
    different kinds may overlap; those of one kind don't.
    """
    rows, spans = parts(documents, text, doc_id)
    identifiers, secret = spans.filter(F.col("kind").isin(*_IDENTIFIERS)), spans.filter(F.col("kind").isin(*_SECRETS))
    weak_id, weak_secret = spans.filter("kind = 'login'"), spans.filter(F.col("kind").isin("passcode", "mixed"))
    endpoints = spans.filter("kind = 'endpoint'")
    strong = spans.filter(F.col("kind").isin(*BASE))
    # an endpoint counts by what lies beside it, whether that counts or not, so one step over endpoints is enough
    hubs = stored(_beside(_beside(endpoints, identifiers), secret), "hubs")
    linked = (
        strong.union(_beside(weak_id, secret))
        .union(_beside(weak_secret, identifiers))
        .union(hubs)
        .union(_beside(weak_id.union(weak_secret), hubs))
    )
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    by_row = linked.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans")
    )
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    return rows.join(by_row, "row", "left").select("doc_id", "row", "copies", F.coalesce("spans", none).alias("spans"))


def redact(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with every span of :func:`secrets` replaced by ``REDACTED``, in all their columns.

    Overlapping spans become one. Null texts stay null.
    """
    found = secrets(documents, text, doc_id).filter("size(spans) > 0").select("row", "spans").dropDuplicates(["row"])
    # spans that begin before an earlier one ends are merged into it
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] < F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    content = F.col("document")[text]
    before = lambda i: F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0))
    pieces = F.transform(
        "cuts", lambda s, i: content.substr((before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int"))
    )
    rest = content.substr((F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length(content))
    cleaned = F.concat(F.concat_ws(REDACTED, pieces), F.lit(REDACTED), rest)
    # the columns stay in a struct of their own, whatever their names
    keyed = documents.select(
        F.struct(*documents.columns).alias("document"), F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("row")
    )
    joined = keyed.join(found.select("row", merged.alias("cuts")), "row", "left")
    new = F.when(F.col("cuts").isNull(), content).otherwise(cleaned)
    return joined.select(*(new.alias(c) if c == text else F.col("document")[c].alias(c) for c in documents.columns))


def digest_columns(found: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of their spans, and all spans as text."""
    shown = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")
