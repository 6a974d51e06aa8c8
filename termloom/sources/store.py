"""The stored index: parquet tables that grow by batches.

    <root>/_state.json                    committed batches and field lengths; the last step of every write
    <root>/corpus/batch=N/pbucket=K/      document records, sorted by path
    <root>/postings/batch=N/tbucket=K/    postings, sorted by term, field and path
    <root>/term_stats/batch=N/tbucket=K/  changes of df and cf, sorted by term and field
    <root>/grams/batch=N/gbucket=K/       three characters of a content term and the term, sorted
    <root>/variants/batch=N/vbucket=K/    a content term without a character and the term, sorted
    <root>/removed/batch=N/               (path, old_batch) that the batch replaces or deletes
    <root>/status/batch=N/                what became of each file that the batch has seen

A batch costs what it adds: a replaced document is hidden by an anti join with ``removed``, and the statistics are
sums of changes. Batches of about one size are folded into a larger one when there are ``FOLD`` of them, so a
document is rewritten once for each power of ``FOLD`` and a search reads few folders. ``compact`` folds everything
into one batch, with as many buckets as its bytes ask for if it is told so. A batch that fails before its commit is
overwritten by the next; folders that the state doesn't name any more are left to the owner.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.operators import analysis, match
from termloom.operators.index import Index, mean_lengths
from termloom.operators.rank import path_bucket

VERSION = "1"

SCHEMAS = {
    "corpus": (
        "path string, filename string, extension string, size bigint, modified_time timestamp, content string, "
        "content_hash string, title string, word_count bigint, language string, tags array<string>, "
        "metadata struct<file_type:string, created_time:string, accessed_time:string, line_count:bigint, "
        "char_count:bigint, paragraph_count:bigint, mime_type:string>, batch int, pbucket int"
    ),
    "postings": (
        "path string, field string, term string, tf bigint, doc_len bigint, positions array<int>, batch int, tbucket int"
    ),
    "term_stats": "field string, term string, df bigint, cf bigint, batch int, tbucket int",
    "grams": "gram string, term string, batch int, gbucket int",
    "variants": "variant string, first string, length int, term string, batch int, vbucket int",
    "removed": "path string, old_batch int, batch int",
    "status": "path string, status string, reason string, word_count bigint, error string, batch int",
}

#: tasks that write one bucket
TASKS_PER_BUCKET = 4
#: batches of one size that are folded into one
FOLD = 8
#: bytes of stored tables for each bucket where their number is derived
BUCKET_BYTES = 1 << 30


@dataclass
class State:
    buckets: int
    stem: bool = False
    batches: list[int] = field(default_factory=list)
    #: the batches that replace or delete documents of earlier ones
    removed_batches: list[int] = field(default_factory=list)
    #: the batches that have told what became of their files
    status_batches: list[int] = field(default_factory=list)
    #: last committed epoch of each ingest stream
    epochs: dict[str, int] = field(default_factory=dict)
    next_batch: int = 0
    #: live documents, and the number of tokens of each field in all of them
    n_docs: int = 0
    total_len: dict[str, int] = field(default_factory=dict)
    #: documents that each batch stored
    batch_docs: dict[str, int] = field(default_factory=dict)


class IndexStore:
    """Reads and writes of one stored index; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, stem: bool | None = None):
        """``buckets`` and ``stem`` (16 and False) hold for a new index; a stored one that differs is an error."""
        self.spark = spark
        self.root = root.rstrip("/")
        state = self._read_state()
        for name, asked in (("buckets", buckets), ("stem", stem)):
            if state is not None and asked is not None and asked != getattr(state, name):
                raise ValueError(f"the index at {self.root} has {name}={getattr(state, name)}, not {asked}")
        self.state = state or State(buckets=buckets or 16, stem=bool(stem))
        self.exists = state is not None

    # --- state file, through the file system of the root ---------------------------------------

    def _hadoop(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return jvm, path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_state(self) -> State | None:
        _, path, fs = self._hadoop("_state.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return State(**json.loads(bytes(stream.readAllBytes()).decode("utf-8")))
        finally:
            stream.close()

    def _write_state(self) -> None:
        jvm, new, fs = self._hadoop("_state.json.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(asdict(self.state)).encode("utf-8")))
        stream.close()
        _, path, _ = self._hadoop("_state.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            path.toUri(), self.spark._jsc.hadoopConfiguration()
        )
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, path, options)  # one atomic step
        self.exists = True

    # --- tables ----------------------------------------------------------------------------------

    def _path(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def _read(self, table: str, batches: list[int]) -> DataFrame:
        if not batches:  # nothing is stored yet
            return self.spark.createDataFrame([], SCHEMAS[table])
        paths = [self._path(table, b) for b in batches]
        # the schema is given: a batch may be empty, and no footer has to be read for it
        reader = self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*paths)

    def _removed(self) -> DataFrame | None:
        if not self.state.removed_batches:
            return None
        return self._read("removed", self.state.removed_batches).select("path", F.col("old_batch").alias("batch"))

    def _live(self, table: str) -> DataFrame:
        rows, removed = self._read(table, self.state.batches), self._removed()
        return rows if removed is None else rows.join(removed, ["path", "batch"], "left_anti")

    def corpus(self) -> DataFrame:
        return self._live("corpus")

    def postings(self) -> DataFrame:
        return self._live("postings")

    def batch_documents(self, batch: int) -> DataFrame:
        """The documents one batch has stored."""
        return self._read("corpus", [batch])

    def doc_stats(self) -> DataFrame:
        """(path, modified_time, batch): a narrow read of the corpus."""
        return self.corpus().select("path", "modified_time", "batch")

    def status(self, batch: int | None = None) -> DataFrame:
        """(path, status, reason, word_count, error, batch) of one batch or of all that told it."""
        return self._read("status", self.state.status_batches if batch is None else [batch])

    def term_changes(self) -> DataFrame:
        return self._read("term_stats", self.state.batches).select("tbucket", "field", "term", "df", "cf")

    def term_stats(self) -> DataFrame:
        rows = self.term_changes()
        if len(self.state.batches) == 1:
            return rows
        totals = rows.groupBy("tbucket", "field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return totals.filter("df > 0")

    def field_stats(self) -> DataFrame:
        """One row for each field that has tokens."""
        rows = [(name, self.state.n_docs, total) for name, total in sorted(self.state.total_len.items())]
        return self.spark.createDataFrame(rows, "field string, n_docs long, total_len long")

    def index(self) -> Index:
        return Index(
            corpus=self.corpus(),
            postings=self.postings(),
            term_stats=self.term_stats(),
            field_stats=mean_lengths(self.field_stats()),
            buckets=self.state.buckets,
            term_changes=self.term_changes(),
            stem=self.state.stem,
            all_postings=self._read("postings", self.state.batches),
            all_corpus=self._read("corpus", self.state.batches),
            removed=self._removed(),
            grams=self._read("grams", self.state.batches).select("gbucket", "gram", "term"),
            variants=self._read("variants", self.state.batches).select("vbucket", "variant", "first", "length", "term"),
        )

    # --- writes ------------------------------------------------------------------------------------

    def _slot(self, key: Column) -> Column:
        """One of a few tasks that write a bucket, by bits of the hash that don't tell the bucket."""
        return F.pmod(F.floor(F.shiftrightunsigned(F.xxhash64(key), 1) / self.state.buckets), F.lit(TASKS_PER_BUCKET)).cast("int")

    def placed(self, documents: DataFrame, unique_paths: bool = False) -> DataFrame:
        """Documents in the order of the corpus table, the newest of each path only.

        The whole rows are shuffled once: a path's rows meet in the task that writes them, sorted by path, time and
        hash, and the first is the newest.
        """
        buckets = self.state.buckets
        rows = documents.withColumn("pbucket", path_bucket(F.col("path"), buckets)).withColumn("pslot", self._slot(F.col("path")))
        rows = rows.repartition(buckets * TASKS_PER_BUCKET, "pbucket", "pslot")
        if unique_paths:
            return rows.sortWithinPartitions("pbucket", "pslot", "path").drop("pslot")
        order = [F.col("modified_time").desc_nulls_last(), F.col("content_hash")]
        place = F.row_number().over(Window.partitionBy("pbucket", "pslot", "path").orderBy(*order))
        return rows.withColumn("_place", place).filter("_place = 1").drop("_place", "pslot")

    def _write_corpus(self, documents: DataFrame, batch: int, unique_paths: bool = False) -> DataFrame:
        """The batch as it is stored; it is read back, so that nothing above it runs twice."""
        placed = self.placed(documents, unique_paths)
        placed.write.mode("overwrite").partitionBy("pbucket").parquet(self._path("corpus", batch))
        return self._read("corpus", [batch])

    def _write_buckets(self, table: str, rows: DataFrame, bucket: str, order: list[str], batch: int) -> DataFrame:
        """Rows by the buckets of the first of the columns they are sorted by, a few tasks for each bucket.

        Tasks are evened out by what the shuffle has written: a part that a frequent term overfills is split, and
        small parts share a task. No sample is taken and nothing is inverted twice.
        """
        key = F.col(order[0])
        placed = rows.withColumn(bucket, match.term_bucket(key, self.state.buckets)).withColumn("_slot", self._slot(key))
        (
            placed.hint("rebalance", 2 * TASKS_PER_BUCKET * self.state.buckets, F.col(bucket), F.col("_slot"))
            .drop("_slot")
            .sortWithinPartitions(bucket, *order)
            .write.mode("overwrite")
            .partitionBy(bucket)
            .parquet(self._path(table, batch))
        )
        return self._read(table, [batch])

    def _write_postings(self, postings: DataFrame, batch: int) -> DataFrame:
        return self._write_buckets("postings", postings, "tbucket", ["term", "field", "path"], batch)

    def _write_term_stats(self, terms: DataFrame, batch: int) -> None:
        self._write_buckets("term_stats", terms, "tbucket", ["term", "field"], batch)

    def _write_grams(self, grams: DataFrame, variants: DataFrame, batch: int) -> None:
        self._write_buckets("grams", grams, "gbucket", ["gram", "term"], batch)
        self._write_buckets("variants", variants, "vbucket", ["variant", "first", "length", "term"], batch)

    def _write_vocabulary(self, batch: int, known: list[int]) -> None:
        """Grams and deletions of the content terms of a batch that the batches before it don't have."""
        terms = self._read("term_stats", [batch]).filter("field = 'content' AND df > 0").select("tbucket", "term")
        if known:
            before = self._read("term_stats", known).filter("field = 'content' AND df > 0").select("tbucket", "term")
            terms = terms.join(before, ["tbucket", "term"], "left_anti")
        self._write_grams(match.gram_rows(terms.select("term")), match.variant_rows(terms.select("term")), batch)

    def _postings(self, corpus: DataFrame) -> DataFrame:
        return analysis.analyze(corpus, self.state.stem).select(
            "path", "field", "term", "tf", "doc_len", "positions"
        )

    def ingest(
        self,
        documents: DataFrame,
        epoch: tuple[str, int] | None = None,
        delete: DataFrame | None = None,
        unique_paths: bool = False,
        status: Callable[[DataFrame], DataFrame] | None = None,
    ) -> int | None:
        """Insert or replace whole documents by path, and delete the paths of ``delete``.

        ``status`` takes the stored (path, word_count) to rows of the status table, which are committed with the batch.

        The newest of several documents with one path wins; ``unique_paths`` says there are none
        and saves the shuffle that finds it. ``epoch`` is the name and the epoch of a stream: None is
        returned when it was committed before, else the batch number.
        """
        if epoch is not None and epoch[1] <= self.state.epochs.get(epoch[0], -1):
            return None
        batch = self.state.next_batch
        corpus = self._write_corpus(documents, batch, unique_paths)
        n_docs = corpus.count()  # from the parquet footers
        if status is not None:
            status(corpus.select("path", "word_count")).write.mode("overwrite").parquet(self._path("status", batch))
            self.state.status_batches.append(batch)
        postings = self._write_postings(self._postings(corpus), batch)
        terms = analysis.term_stats(postings)
        n_removed = 0
        if self.state.batches:
            touched = corpus.select("path")
            if delete is not None:
                touched = touched.unionByName(delete.select("path")).distinct()
            old = self.doc_stats().join(touched, "path", "left_semi")
            old.select("path", F.col("batch").alias("old_batch")).write.mode("overwrite").parquet(
                self._path("removed", batch)
            )
            removed = self._read("removed", [batch]).select("path", F.col("old_batch").alias("batch"))
            n_removed = removed.count()
        if n_removed:
            # what the replaced documents had added to the statistics is taken out again
            removed = removed.withColumn("pbucket", path_bucket(F.col("path"), self.state.buckets))
            gone = self._read("corpus", self.state.batches).join(removed, ["path", "batch", "pbucket"], "left_semi")
            # stems are merged in postings; words are counted without them
            lost = analysis.term_stats(self._postings(gone)) if self.state.stem else analysis.token_stats(gone)
            terms = (
                terms.unionByName(lost.select("field", "term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
                .groupBy("field", "term")
                .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
            )
        self._write_term_stats(terms, batch)
        self._write_vocabulary(batch, self.state.batches)
        for name, total in self._lengths(batch).items():
            self.state.total_len[name] = self.state.total_len.get(name, 0) + total
        self.state.n_docs += n_docs - n_removed
        self.state.batches.append(batch)
        self.state.batch_docs[str(batch)] = n_docs
        if n_removed:
            self.state.removed_batches.append(batch)
        self.state.next_batch = batch + 1
        if epoch is not None:
            self.state.epochs[epoch[0]] = epoch[1]
        self._write_state()
        while self._fold():
            pass
        return batch

    def _lengths(self, batch: int) -> dict[str, int]:
        """Tokens of each field in a batch: the sum of all term frequencies, at most four rows."""
        totals = self._read("term_stats", [batch]).groupBy("field").agg(F.sum("cf").alias("total"))
        return {row.field: row.total for row in totals.collect()}

    def _fold(self) -> bool:
        """Fold the batches of one size into one when there are enough of them; the smallest size first."""
        tiers: dict[int, list[int]] = {}
        for batch in self.state.batches:
            docs = self.state.batch_docs.get(str(batch), 0)
            tiers.setdefault(0 if docs < FOLD else int(math.log(docs, FOLD)), []).append(batch)
        folded = next((batches for _, batches in sorted(tiers.items()) if len(batches) >= FOLD), None)
        if folded is None:
            return False
        batch, removed = self.state.next_batch, self._removed()

        def live(table: str) -> DataFrame:
            rows = self._read(table, folded)
            return rows if removed is None else rows.join(removed, ["path", "batch"], "left_anti")

        n_docs = self._write_corpus(live("corpus").drop("batch", "pbucket"), batch, unique_paths=True).count()
        self._write_postings(live("postings").drop("batch", "tbucket"), batch)
        # sums of changes, those below zero too: they take from what other batches have added
        changes = self._read("term_stats", folded).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        self._write_term_stats(changes.filter("df <> 0 OR cf <> 0"), batch)
        self._write_grams(
            self._read("grams", folded).select("gram", "term"),
            self._read("variants", folded).select("variant", "first", "length", "term"), batch,
        )
        rest = [b for b in self.state.batches if b not in folded]
        if self.state.removed_batches:
            # what hides documents of the other batches
            kept = self._read("removed", self.state.removed_batches).filter(F.col("old_batch").isin(rest)).select("path", "old_batch")
            kept.write.mode("overwrite").parquet(self._path("removed", batch))
            self.state.removed_batches = [batch]
        self.state.batches = [*rest, batch]
        self.state.batch_docs = {str(b): self.state.batch_docs.get(str(b), 0) for b in rest} | {str(batch): n_docs}
        self.state.next_batch = batch + 1
        self._write_state()
        return True

    def _stored_bytes(self) -> int:
        total = 0
        for table in ("corpus", "postings"):
            for batch in self.state.batches:
                _, path, fs = self._hadoop(f"{table}/batch={batch}")
                total += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
        return total

    def compact(self, buckets: int | None = None, rebucket: bool = False) -> int:
        """Fold all live documents and postings into one batch; old folders are left to the owner.

        ``buckets`` sets their number anew, ``rebucket`` derives it from the bytes that are stored.
        """
        batch = self.state.next_batch
        corpus, postings, terms = self.corpus(), self.postings(), self.term_stats()
        if rebucket and buckets is None:
            buckets = max(1, -(-self._stored_bytes() // BUCKET_BYTES))
        self.state.buckets = buckets or self.state.buckets
        n_docs = self._write_corpus(corpus.drop("batch", "pbucket"), batch, unique_paths=True).count()
        self._write_postings(postings.drop("batch", "tbucket"), batch)
        self._write_term_stats(terms.drop("tbucket"), batch)
        self._write_vocabulary(batch, [])
        self.state.n_docs = n_docs
        self.state.total_len = self._lengths(batch)
        self.state.batches = [batch]
        self.state.batch_docs = {str(batch): n_docs}
        self.state.removed_batches = []
        self.state.next_batch = batch + 1
        self._write_state()
        return batch
