"""Line dedup that can be taken back: sharded cuckoo filters in front of exact reference-count tables.

A store holds, for every line long enough, the documents it is in (``refs``) and their number and the last of them
(``totals``); both are exact and keyed by 128 bits of BLAKE2. Lines fall into shards by ranges of their keys. Of each
shard two chains of cuckoo filters are kept, of the lines that some document holds and of those that enough documents
hold to be repeated. Filters have a fixed size; a chain gets another one when the last is full.

* Inserting documents asks the first chain which of their lines may be known; only those meet the totals.
* Deleting documents lowers counts. A line that falls below the threshold of a chain is taken out of its filters,
  which a cuckoo filter allows, and only the exact counts can tell when: so deletions leave no false negatives.
* The second chain keeps lines that aren't repeated out of the join that decides what is dropped.

Each change is a version: tables are only added to, and a version counts once its row of ``commits`` is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.words import mix

LEAST_DOCUMENTS = 3
LEAST_LENGTH = 20
#: Lines of a shard when its store begins.
SHARD_LINES = 80_000
#: Buckets of a filter of known lines, and of one of repeated lines; each has four slots of 16 bits.
KNOWN_BUCKETS, REPEATED_BUCKETS = 1 << 15, 1 << 12
#: Share of the slots that are filled before a chain gets another filter.
LOAD = 0.85
#: Bytes of filters that are sent to the tasks at once; more of them go in several passes, each over its own lines.
FILTER_BYTES = 32 << 20

_SPACE = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))
_SLOTS = 4
_KICKS = 500


class Cuckoo:
    """A cuckoo filter of 64-bit hashes, by whole arrays: 16 bits of each in one of two buckets."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.slots = np.zeros((buckets, _SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(buckets, _SLOTS).copy()
        self.used = int(np.count_nonzero(self.slots))

    def _prints(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = hashes.view(np.uint64)
        prints = np.maximum(bits & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        return prints, ((bits >> np.uint64(16)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def room(self) -> int:
        return int(LOAD * self.slots.size) - self.used

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, bucket = self._prints(hashes)
        found = (self.slots[bucket] == prints[:, None]).any(axis=1)
        return found | (self.slots[self._other(prints, bucket)] == prints[:, None]).any(axis=1)

    def _place(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Fill free slots; which prints found none."""
        order = np.argsort(bucket, kind="stable")
        ranked = bucket[order]
        begin = np.flatnonzero(np.diff(ranked, prepend=-1))
        rank = np.arange(len(ranked)) - np.repeat(begin, np.diff(begin, append=len(ranked)))
        taken = self.slots[ranked] != 0
        fits = rank < _SLOTS - taken.sum(axis=1)
        free_first = np.argsort(taken[fits], axis=1, kind="stable")
        self.slots[ranked[fits], free_first[np.arange(fits.sum()), rank[fits]]] = prints[order[fits]]
        self.used += int(fits.sum())
        left = np.ones(len(prints), bool)
        left[order[fits]] = False
        return left

    def add(self, hashes: np.ndarray) -> None:
        """Adds hashes that there is :meth:`room` for."""
        prints, bucket = self._prints(hashes)
        random = np.random.default_rng(self.used)
        left = self._place(prints, bucket)
        prints, bucket = prints[left], self._other(prints[left], bucket[left])
        for _ in range(_KICKS):
            left = self._place(prints, bucket)
            prints, bucket = prints[left], bucket[left]
            if len(prints) == 0:
                return
            # one print of each full bucket takes the place of another, which goes on to its other bucket
            _, one = np.unique(bucket, return_index=True)
            slot = random.integers(0, _SLOTS, len(one))
            out = self.slots[bucket[one], slot]
            self.slots[bucket[one], slot] = prints[one]
            prints[one] = out
            bucket[one] = self._other(out, bucket[one])
        raise RuntimeError("a cuckoo filter is too full")

    def remove(self, hashes: np.ndarray) -> np.ndarray:
        """Takes one print of each hash out; which hashes had none here."""
        prints, bucket = self._prints(hashes)
        other = self._other(prints, bucket)
        missing = np.ones(len(prints), bool)
        for k in range(len(prints)):
            for b in (bucket[k], other[k]):
                hit = np.flatnonzero(self.slots[b] == prints[k])
                if len(hit):
                    self.slots[b, hit[0]] = 0
                    self.used -= 1
                    missing[k] = False
                    break
        return missing


def in_chain(chain: list[Cuckoo], hashes: np.ndarray) -> np.ndarray:
    found = np.zeros(len(hashes), bool)
    for one in chain:
        found |= one.contains(hashes)
    return found


def add_to_chain(chain: list[Cuckoo], hashes: np.ndarray, buckets: int) -> None:
    while len(hashes):
        with_room = next((one for one in chain if one.room() > 0), None)
        if with_room is None:
            with_room = Cuckoo(buckets)
            chain.append(with_room)
        n = with_room.room()
        with_room.add(hashes[:n])
        hashes = hashes[n:]


def remove_from_chain(chain: list[Cuckoo], hashes: np.ndarray) -> None:
    for one in chain:
        # only a filter that has the print can give it back
        hashes = hashes[one.remove(hashes)]
    if len(hashes):
        raise RuntimeError("a line to be removed is in no filter")


def _key(line: bytes, least: int) -> bytes | None:
    """16 bytes that stand for the line's key; None if that is too short."""
    key = line.strip(_SPACE).lower()  # lower() of bytes leaves all but A-Z alone
    if len(key) < least or len(key) < 4 * least and len(key.translate(None, _INNER)) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _line_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text) -> (hi, lo, doc_id, tag), once for each key of a row."""
    for batch in batches:
        keys, sizes = [], []
        for text in batch.column("text"):
            own = {k for line in text.as_py().split(b"\n") if (k := _key(line, least)) is not None}
            keys.extend(own)
            sizes.append(len(own))
        pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column("doc_id").take(row), batch.column("tag").take(row)],
            names=["hi", "lo", "doc_id", "tag"],
        )


def _without(batches: Iterator[pa.RecordBatch], least: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, drops) -> counts and what remains of the text."""
    for batch in batches:
        rows = []
        for text, drops in zip(batch.column("text"), batch.column("drops").to_pylist(), strict=True):
            raw = text.as_py()
            lines = raw.split(b"\n")
            kept = lines
            if drops:
                gone = {d["hi"].to_bytes(8, "little", signed=True) + d["lo"].to_bytes(8, "little", signed=True) for d in drops}
                kept = [line for line in lines if _key(line, least) not in gone]
                raw = b"\n".join(kept)
            rows.append((len(lines), len(lines) - len(kept), hashlib.sha256(raw).hexdigest(), *((raw,) if texts else ())))
        kinds = (pa.int64(), pa.int64(), pa.string(), *((pa.binary(),) if texts else ()))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256", *(("kept",) if texts else ())],
        )


def _longs(table: pa.Table, column: str) -> np.ndarray:
    return np.ascontiguousarray(table.column(column).to_numpy(), np.int64)


def _chains(filters: pa.Table) -> dict[int, list[Cuckoo]]:
    chains: dict[int, list[tuple[int, Cuckoo]]] = {}
    for row in filters.select(["level", "number", "buckets", "slots"]).to_pylist():
        chains.setdefault(row["level"], []).append((row["number"], Cuckoo(row["buckets"], row["slots"])))
    return {level: [one for _, one in sorted(chain, key=lambda c: c[0])] for level, chain in chains.items()}


_FILTERS = "shard long, level int, number int, buckets int, slots binary"
_KNOWN, _REPEATED = 0, 1


class LineStore:
    """The lines of a growing and shrinking set of documents, in a folder that all executors share; one writer at a time.

    Documents are told apart by their id. A document that is inserted again takes the place of the old one; several
    rows of one id in one insert are one document. Rows without an id are told apart by their texts, stand before
    all ids, and can't be deleted by one. Null texts are empty ones. No documents make no difference.
    """

    def __init__(self, spark: SparkSession, path: str, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH):
        self.spark, self.path = spark, path.rstrip("/")
        self.least_documents, self.least_length = least_documents, least_length
        self.versions: list[int] = []
        self.shards = 0
        # the folder is looked up by Spark's own file system
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            rows = spark.read.schema("version int, shards long, least_documents int, least_length int").parquet(f"{self.path}/commits").collect()
            for row in rows:
                if (row["least_documents"], row["least_length"]) != (least_documents, least_length):
                    raise ValueError("the store has other thresholds")
                self.shards = row["shards"]
            self.versions = sorted(row["version"] for row in rows)

    # --- tables ------------------------------------------------------------------------------------

    _SCHEMAS = {
        "refs": "hi long, lo long, doc_id long, tag long",
        "gone": "doc_id long, tag long",
        "totals": "hi long, lo long, old long, n long, last struct<doc_id:long,tag:long>",
        "filters": _FILTERS,
    }

    def _write(self, table: str, frame: DataFrame, version: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/{table}/version={version}")

    def _read(self, table: str, versions: list[int]) -> DataFrame:
        schema = self._SCHEMAS[table] + ", version int"
        if not versions:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*[f"{self.path}/{table}/version={v}" for v in versions])

    def _commit(self, version: int) -> None:
        row = [(version, self.shards, self.least_documents, self.least_length)]
        frame = self.spark.createDataFrame(row, "version int, shards long, least_documents int, least_length int")
        frame.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.versions.append(version)

    def _next(self) -> int:
        return self.versions[-1] + 1 if self.versions else 0

    def _shard(self, hi: Column) -> Column:
        """Ranges of the leading half of a key."""
        return F.shiftright((F.shiftright(hi, 32) + (1 << 31)) * F.lit(self.shards), 32)

    def refs(self) -> DataFrame:
        """(hi, lo, doc_id, tag) of all live documents."""
        refs = self._read("refs", self.versions)
        if len(self.versions) > 1:
            gone = self._read("gone", self.versions).select(
                F.col("doc_id").alias("g_id"), F.col("tag").alias("g_tag"), F.col("version").alias("g_version")
            )
            later = (F.col("doc_id") == F.col("g_id")) & (F.col("tag") == F.col("g_tag")) & (F.col("g_version") > F.col("version"))
            refs = refs.join(gone, later, "left_anti")
        return refs.drop("version")

    def totals(self) -> DataFrame:
        """(hi, lo, n, last): in how many live documents each line is, and the last of them."""
        totals = self._read("totals", self.versions)
        if len(self.versions) == 1:
            return totals.select("hi", "lo", "n", "last")
        newest = F.max(F.struct("version", "n", "last")).alias("newest")
        return totals.groupBy("hi", "lo").agg(newest).select("hi", "lo", "newest.n", "newest.last").filter("n > 0")

    def filters(self, level: int | None = None) -> DataFrame:
        """The newest filters of each shard."""
        filters = self._read("filters", self.versions)
        if len(self.versions) > 1:
            newest = filters.groupBy("shard").agg(F.max("version").alias("version"))
            filters = filters.join(newest, ["shard", "version"], "left_semi")
        filters = filters.drop("version")
        return filters if level is None else filters.filter(F.col("level") == level)

    # --- changes -----------------------------------------------------------------------------------

    def _documents(self, documents: DataFrame, text: str, doc_id: str) -> DataFrame:
        content = F.coalesce(F.col(text), F.lit(""))
        ids = F.col(doc_id).cast("long")
        tag = F.when(ids.isNull(), F.xxhash64(content)).otherwise(F.lit(0))
        return documents.select(ids.alias("doc_id"), tag.cast("long").alias("tag"), content.cast("binary").alias("text"))

    def _known(self, counts: DataFrame) -> DataFrame:
        """Counts of new documents with the earlier count of each line: a line that no filter knows has none."""

        def probe(key, changes: pa.Table, filters: pa.Table) -> pa.Table:
            chain = _chains(filters).get(_KNOWN, [])
            return changes.drop(["shard"]).append_column("known", pa.array(in_chain(chain, _longs(changes, "lo"))))

        sharded = counts.withColumn("shard", self._shard(F.col("hi")))
        probed = (
            sharded.groupBy("shard")
            .cogroup(self.filters(_KNOWN).groupBy("shard"))
            .applyInArrow(probe, "hi long, lo long, n long, last struct<doc_id:long,tag:long>, known boolean")
        )
        before = self.totals().select("hi", "lo", F.col("n").alias("old"), F.col("last").alias("old_last"))
        known = probed.filter("known").join(before, ["hi", "lo"], "left")
        columns = ("hi", "lo", "old", "n", "last")
        merged = known.select(
            "hi", "lo", F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("n")).alias("n"),
            F.greatest("old_last", "last").alias("last"),
        )
        return merged.select(*columns).unionByName(probed.filter("NOT known").withColumn("old", F.lit(0).cast("long")).select(*columns))

    def _update_filters(self, version: int) -> None:
        """Lines that the version brings over a threshold go into the filters, those that it brings below go out."""
        levels = {_KNOWN: (1, KNOWN_BUCKETS), _REPEATED: (self.least_documents, REPEATED_BUCKETS)}
        schema = [f.split() for f in _FILTERS.split(", ")]

        def update(key, changes: pa.Table, filters: pa.Table) -> pa.Table:
            chains, rows = _chains(filters), []
            lo, old, new = (_longs(changes, c) for c in ("lo", "old", "n"))
            for level, (least, buckets) in levels.items():
                chain = chains.get(level, [])
                remove_from_chain(chain, lo[(old >= least) & (new < least)])
                add_to_chain(chain, lo[(old < least) & (new >= least)], buckets)
                rows += [(key[0].as_py(), level, k, buckets, one.slots.tobytes()) for k, one in enumerate(chain)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.table({name: pa.array([r[i] for r in rows], kinds[i]) for i, (name, _) in enumerate(schema)})

        crossed = F.lit(False)
        for least, _ in levels.values():
            crossed = crossed | ((F.col("old") < least) != (F.col("n") < least))
        totals = self._read("totals", [version]).filter(crossed)
        changes = totals.select(self._shard(F.col("hi")).alias("shard"), "lo", "old", "n")
        grouped = changes.groupBy("shard")
        if self.versions:
            touched = changes.select("shard").distinct()
            before = self.filters().join(touched, "shard", "left_semi")
            made = grouped.cogroup(before.groupBy("shard")).applyInArrow(update, _FILTERS)
        else:
            empty = pa.table({name: pa.array([], pa.binary() if kind == "binary" else pa.int64()) for name, kind in schema})
            made = grouped.applyInArrow(lambda key, rows: update(key, rows, empty), _FILTERS)
        self._write("filters", made, version)

    def insert(self, documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        rows = self._documents(documents, text, doc_id)
        if self.versions:
            self.delete(rows.filter("doc_id IS NOT NULL").select("doc_id").distinct())
        version = self._next()
        least = self.least_length
        keys = rows.select("doc_id", "tag", "text").mapInArrow(lambda b: _line_keys(b, least), self._SCHEMAS["refs"])
        # the whole rows are dealt out, so that a line of very many documents is in all tasks
        self._write("refs", keys.distinct().sortWithinPartitions("hi"), version)
        self._write("gone", self.spark.createDataFrame([], self._SCHEMAS["gone"]), version)
        new = self._read("refs", [version])
        if self.versions and not new.filter("doc_id IS NULL").isEmpty():
            # texts without an id that are here already don't count again
            here = self.refs().filter("doc_id IS NULL").select("hi", "lo", "tag")
            nameless = new.filter("doc_id IS NULL").join(here, ["hi", "lo", "tag"], "left_anti")
            new = new.filter("doc_id IS NOT NULL").unionByName(nameless)
        counts = new.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "tag")).alias("last"))
        if self.versions and self.shards:
            counts = self._known(counts)
        else:
            counts = counts.select("hi", "lo", F.lit(0).cast("long").alias("old"), "n", "last")
        self._write("totals", counts, version)
        if not self.shards:
            self.shards = -(-self._read("totals", [version]).count() // SHARD_LINES)
        self._update_filters(version)
        self._commit(version)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Take documents out by their ids; ids that aren't there make no difference."""
        if not self.versions:
            return
        version = self._next()
        wanted = ids.select(F.col(doc_id).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
        live = self.refs()
        self._write("gone", live.join(wanted, "doc_id", "left_semi").select("doc_id", "tag").distinct(), version)
        gone = self._read("gone", [version]).select("doc_id", "tag")
        if gone.isEmpty():
            return
        self._write("refs", self.spark.createDataFrame([], self._SCHEMAS["refs"]), version)
        lost = live.join(gone, ["doc_id", "tag"], "left_semi").groupBy("hi", "lo").agg(F.count("*").alias("lost"))
        rest = live.join(gone, ["doc_id", "tag"], "left_anti").join(lost.select("hi", "lo"), ["hi", "lo"], "left_semi")
        last = rest.groupBy("hi", "lo").agg(F.max(F.struct("doc_id", "tag")).alias("last"))
        changed = (
            self.totals().drop("last").join(lost, ["hi", "lo"]).join(last, ["hi", "lo"], "left")
            .select("hi", "lo", F.col("n").alias("old"), (F.col("n") - F.col("lost")).alias("n"), "last")
        )
        self._write("totals", changed, version)
        self._update_filters(version)
        self._commit(version)

    # --- results -----------------------------------------------------------------------------------

    def drops(self) -> DataFrame:
        """(doc_id, tag, hi, lo): the lines that each live document loses, those of enough documents but the last."""
        if not self.shards:
            return self._read("refs", []).drop("version").select("doc_id", "tag", "hi", "lo")
        filters = self.filters(_REPEATED)
        sizes = filters.groupBy("shard").agg(F.sum(F.octet_length("slots")).alias("size")).orderBy("shard").collect()
        blocks: list[list[int]] = [[]]
        room = FILTER_BYTES
        for row in sizes:  # a row for each shard, no lines
            if row["size"] > room and blocks[-1]:
                blocks.append([])
                room = FILTER_BYTES
            blocks[-1].append(row["shard"])
            room -= row["size"]
        refs = self.refs().withColumn("shard", self._shard(F.col("hi")))
        parts = []
        for block in blocks:
            if not block:
                continue
            chains: dict[int, list[Cuckoo]] = {}
            for row in filters.filter(F.col("shard").between(block[0], block[-1])).orderBy("shard", "number").collect():
                chains.setdefault(row["shard"], []).append(Cuckoo(row["buckets"], bytes(row["slots"])))
            sent = self.spark.sparkContext.broadcast(chains)

            def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    shard, lo = _longs(batch, "shard"), _longs(batch, "lo")
                    keep = np.zeros(len(batch), bool)
                    for one in np.unique(shard):
                        if one in sent.value:
                            own = np.flatnonzero(shard == one)
                            keep[own] = in_chain(sent.value[one], lo[own])
                    yield batch.filter(pa.array(keep))

            own = refs.filter(F.col("shard").between(block[0], block[-1]))
            parts.append(own.mapInArrow(hits, own.schema))
        if not parts:
            return refs.filter("false").select("doc_id", "tag", "hi", "lo")
        maybe = parts[0]
        for part in parts[1:]:
            maybe = maybe.unionByName(part)
        repeated = self.totals().filter(F.col("n") >= self.least_documents).select("hi", "lo", "last")
        other = ~(F.col("doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("tag") == F.col("last.tag")))
        return maybe.join(repeated, ["hi", "lo"]).filter(other).select("doc_id", "tag", "hi", "lo")

    def clean(self, documents: DataFrame, text: str = "text", doc_id: str = "doc_id", texts: bool = True) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_sha256, kept): the documents without the lines that they lose.

        Lines are what lies between line feeds, so an empty text has one. ``kept`` is what remains, as bytes, joined by
        line feeds; ``texts=False`` leaves it out. Each row has its row; a document that isn't in the store loses nothing.
        Other columns are ignored.
        """
        lists = self.drops().groupBy("doc_id", "tag").agg(F.collect_list(F.struct("hi", "lo")).alias("drops"))
        lists = lists.select(F.col("doc_id").alias("d_id"), F.col("tag").alias("d_tag"), "drops")
        rows = self._documents(documents, text, doc_id)
        joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("tag") == F.col("d_tag")), "left")
        least = self.least_length
        result = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept binary" if texts else "")
        return joined.select("doc_id", "text", "drops").mapInArrow(lambda b: _without(b, least, texts), result)
