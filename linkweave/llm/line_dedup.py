"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps what is known about line keys as sorted runs: ``key`` (128-bit
digest as text), ``holder`` (the document that keeps the line) and ``n_docs`` (documents
counted so far). The runs of a level are appends to one table bucketed and sorted by ``key`` in the
shared scratch folder, all levels in the same number of buckets, so Spark joins and merges runs
bucket by bucket and shuffles only the new batch. A bucket takes about ``BUCKET_ROWS`` keys of all batches, so the
files of a run grow with the input and not with the session's number of partitions. Batches of documents come in descending ``doc_id`` order. A
batch is reduced to one row per key, merge-anti-joined with the runs - only keys that no run
knows get a ``holder`` - and its rows become a new run on level 0. When ``fanout`` runs stand on
a level they are merged (counts added) into one run of the next level, so ``b``
batches leave O(fanout * log b) runs. Because batches descend, the holder that a
key gets first is its largest ``doc_id``.

A line is known by its place in its text, so dropping lines takes time in proportion to the
text whatever the number of lines that go. Keys that stand in very many documents are few
(at most ``heavy`` have a share of 1 / ``heavy`` of all); they are broadcast, so no task gets
all places of one.

Contract of ``dedup_lines`` (one result row per input row):

* null or empty text: one empty line, nothing dropped;
* a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys
  shorter than ``min_chars`` code points are never dropped;
* a key held by at least ``min_docs`` distinct documents loses all its lines
  except those in the largest ``doc_id`` that holds it (every occurrence there stays);
* rows that repeat a ``doc_id`` are one document for the count; rows with a null
  ``doc_id`` are neither counted nor changed;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.session import materialize, scratch_path

BLANKS = " \t\n\x0b\x0c\r"
HEAVY = 10_000
BUCKET_ROWS = 500_000
PARTS = 64


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased (other letters stay)."""
    return F.translate(F.trim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs; ``add`` takes batches whose doc_ids lie below those of all batches before.

    A level is one bucketed table, a run of it one append, so a bucket of all runs of a level is
    read by one task. ``buckets``: as many as the session has shuffle partitions if not given.
    """

    def __init__(self, fanout: int = 4, buckets: int | None = None):
        self.fanout, self.buckets = fanout, buckets
        self.levels: list[tuple[DataFrame | None, int]] = []  # table, runs in it
        self._places: dict[int, tuple[str, str]] = {}  # name and folder of each level's table

    def runs(self) -> list[DataFrame]:
        """The tables in force, one per level that holds runs."""
        return [table for table, n in self.levels if n]

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max("holder").alias("holder"), F.sum("n_docs").alias("n_docs"))

    def _buckets(self, rows: DataFrame) -> int:
        return self.buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, name: str, path: str) -> DataFrame:
        (rows.select("key", "holder", "n_docs").write.format("parquet").mode("append")
         .bucketBy(self._buckets(rows), "key").sortBy("key")
         .option("path", path).saveAsTable(name))
        return rows.sparkSession.table(name)

    def judged(self, batch: DataFrame) -> DataFrame:
        """``(key, holder, n_docs)`` of a batch: the holder is null for keys that a run knows."""
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")  # of a frequent key no task gets all documents
        rows = (batch.select("key", "doc_id", part).repartition("key", "part").distinct()
                .groupBy("key", "part").agg(F.max("doc_id").alias("holder"), F.count(F.lit(1)).alias("n_docs"))
                .repartition(self._buckets(batch), "key").groupBy("key").agg(F.max("holder").alias("holder"), F.sum("n_docs").alias("n_docs")))
        for run in self.runs():  # a key has its holder in one run only
            seen = run.where("holder IS NOT NULL").select("key", F.lit(True).alias("seen"))
            rows = (rows.join(seen, "key", "left")
                    .select("key", F.when(F.col("seen").isNull(), F.col("holder")).alias("holder"), "n_docs"))
        return rows

    def add(self, batch: DataFrame) -> None:
        """``batch``: ``(key, doc_id)`` rows."""
        self._push(0, self.judged(batch))

    def _push(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append((None, 0))
        table, n = self.levels[level]
        if table is None:
            name = f"line_runs_{uuid.uuid4().hex}"
            self._places[level] = (name, scratch_path(rows.sparkSession, f"line-runs-{level}"))
        self.levels[level] = (self._write(rows, *self._places[level]), n + 1)
        if n + 1 >= self.fanout:
            full, self.levels[level] = self.levels[level][0], (None, 0)
            self._push(level + 1, self._merge(full))

    def totals(self) -> DataFrame | None:
        """One row per key: holder (largest doc_id) and number of documents; levels are merged into one."""
        for level in range(len(self.levels) - 1):
            table, n = self.levels[level]
            if n:
                self.levels[level] = (None, 0)
                self._push(level + 1, self._merge(table))
        return self._merge(self.runs()[0]) if self.runs() else None


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Upper doc_id bounds that cut the ids into about equal batches (ascending)."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 5, fanout: int = 4,
                heavy: int = HEAVY) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)``: every row with its kept lines joined by a line feed."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = batch_bounds(docs, batches)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("doc_id") > F.lit(b)).cast("int")
    row = F.xxhash64("text").alias("row")  # rows that repeat an id differ by their text
    keys = (docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
            .select("doc_id", row, F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
            .where(F.length("line") >= min_chars)
            .select("doc_id", "row", "place", line_key(F.col("line")).alias("line"))
            .where(F.length("line") >= min_chars)
            .select(batch.alias("batch"), "doc_id", "row", "place", F.md5("line").alias("key")))
    keys = materialize(keys, "line-keys")
    runs = LineRuns(fanout, max(1, -(-keys.count() // BUCKET_ROWS)))
    for i in range(len(bounds), -1, -1):
        runs.add(keys.where(F.col("batch") == i))
    hot = materialize(runs.totals().where(F.col("n_docs") >= min_docs), "line-hot")
    held = hot.agg(F.sum("n_docs")).first()[0] or 0
    often = F.col("n_docs") * F.lit(heavy) >= F.lit(held)  # at most ``heavy`` keys
    few, rest = (hot.where(x).select("key", "holder") for x in (often, ~often))
    found = [keys.join(F.broadcast(few), "key"),
             keys.join(F.broadcast(few.select("key")), "key", "left_anti").join(rest, "key")]
    losing = (found[0].unionByName(found[1]).where("doc_id <> holder")
              .groupBy("doc_id", "row").agg(F.collect_list("place").alias("losing")))

    cut = (docs.select("doc_id", row, "text").join(losing, ["doc_id", "row"], "left")
           .select("doc_id", "losing", lines_of(F.col("text")).alias("lines")))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("losing"))
    kept = F.transform(places, lambda i: F.get(F.col("lines"), i))
    left = F.when(F.col("losing").isNull(), F.col("lines")).otherwise(kept)
    return (cut.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), left.alias("left"))
            .select("doc_id", "n_lines", (F.col("n_lines") - F.size("left")).cast("bigint").alias("n_dropped"),
                    F.array_join("left", "\n").alias("text")))
