"""Versioned crawl store (K6 writer side).

Replacing rows of a Parquet table that the same plan reads would delete the
input while the job still needs it. Every write therefore goes to a new version
directory ``v=<millis>-<n>/{crawls,backlinks}`` (partitioned by release), and
readers switch to the newest version whose two tables are both committed
(``_SUCCESS``). Old versions stay readable until removed by retention.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.operators.crawls import (BACKLINK_COLS, CRAWL_COLS, crawl_counts, normalise_targets,
                                        upsert_crawls)
from linkweave.operators.graph import DEFAULT_BUCKETS, inbound
from linkweave.operators.joins import tasks_for
from linkweave.session import scratch_path
from linkweave.sinks import parts
from linkweave.sources.tables import BACKLINKS_SCHEMA, CRAWLS_SCHEMA, read_backlinks, read_crawls


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jp = jvm.org.apache.hadoop.fs.Path(path)
    return jp, jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str) -> bool:
    jp, fs = _fs(spark, path + "/_SUCCESS")
    return bool(fs.exists(jp))


def versions(spark: SparkSession, root: str) -> list[str]:
    """Committed version paths under ``root``, oldest first."""
    jp, fs = _fs(spark, root)
    if not fs.exists(jp):
        return []
    out = []
    for st in fs.listStatus(jp):
        name = st.getPath().getName()
        p = st.getPath().toString()
        if st.isDirectory() and name.startswith("v=") and \
                _committed(spark, p + "/crawls") and _committed(spark, p + "/backlinks"):
            out.append(p)
    return sorted(out)


def latest_version(spark: SparkSession, root: str) -> str | None:
    v = versions(spark, root)
    return v[-1] if v else None


def _new_version_path(root: str) -> str:
    return f"{root.rstrip('/')}/v={int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"


def _write_crawls(crawls: DataFrame, path: str) -> None:
    crawls.select(*CRAWL_COLS).write.option("compression", "zstd").partitionBy("release").parquet(path)


def _write_backlinks(backlinks: DataFrame, path: str) -> None:
    _write_clustered(backlinks.select(*BACKLINK_COLS),
                     lambda df: df.write.option("compression", "zstd").partitionBy("release").parquet(path))


def _write_clustered(backlinks: DataFrame, write) -> None:
    """``write(df)`` of the backlinks in ranges of (release, target, linking_domain).

    Files cover disjoint (release, target) ranges, so a one-target report reads one or two of them; the
    linker in the range key spreads a hot target over several files. The rows are written plainly first: they
    are computed once (finding the ranges would compute them again), and their number gives that of the tasks.
    """
    spark = backlinks.sparkSession
    by = ["release", "target", "linking_domain"]
    path = scratch_path(spark, "backlinks-unordered")
    backlinks.write.parquet(path)
    plain = spark.read.schema(backlinks.schema).parquet(path)
    write(plain.repartitionByRange(tasks_for(spark, plain.count()), *by).sortWithinPartitions(*by))
    jp, fs = _fs(spark, path)
    fs.delete(jp, True)


def _claim(spark: SparkSession, path: str) -> bool:
    """Create a marker file that must not exist yet; False if another writer was first."""
    jp, fs = _fs(spark, path)
    fs.mkdirs(jp.getParent())
    return bool(fs.createNewFile(jp))


def _rename(spark: SparkSession, src: str, dst: str) -> None:
    jvm = spark.sparkContext._jvm
    s, d = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    if not s.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(s, d):
        raise OSError(f"could not move {src} to {dst}")


def write_version(crawls: DataFrame, backlinks: DataFrame, root: str) -> str:
    """Write a new store version and return its path."""
    path = _new_version_path(root)
    _write_crawls(crawls, f"{path}/crawls")
    _write_backlinks(backlinks, f"{path}/backlinks")
    return path


def read_version(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_crawls(spark, path).select(*CRAWL_COLS), read_backlinks(spark, path).select(*BACKLINK_COLS)


def read_latest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    p = latest_version(spark, root)
    return read_version(spark, p) if p else None


def write_crawl_runs(root: str, runs: list[dict], existing: tuple[DataFrame, DataFrame] | None = None,
                     n_buckets: int = DEFAULT_BUCKETS) -> str:
    """Q10 + K6 as one batch job: crawl several (targets, graph, release) runs into a new store version.

    Each run is a dict with targets, vertices, edges, release, as_of (one release per run).
    The backlinks of all runs are written first; the crawl rows (with zero-result
    crawls) are then counted from the written backlinks instead of re-running the
    graph joins. With ``existing`` (crawls, backlinks; the newest version when the call
    starts) the runs replace their (target, release) keys in it. Of two writers that start
    from one version only the first commits; the other raises and has to start again from
    the new version (``append_crawl_runs`` lets both commit).
    """
    spark = runs[0]["vertices"].sparkSession
    path = _new_version_path(root)
    base = latest_version(spark, root) if existing is not None else None
    links = None
    for r in runs:
        t = normalise_targets(r["targets"])
        b = inbound(r["edges"], r["vertices"], t, n_buckets).select(
            "target", F.lit(r["release"]).alias("release"), "linking_domain",
            F.col("num_hosts").cast("long").alias("num_hosts"), F.lit(None).cast("double").alias("page_rank"))
        links = b if links is None else links.unionByName(b)
    staged = f"{path}/_staged_backlinks"
    _write_backlinks(links, staged)
    new_b = spark.read.schema(BACKLINKS_SCHEMA).parquet(staged).select(*BACKLINK_COLS)
    new_c = None
    for r in runs:
        c = crawl_counts(normalise_targets(r["targets"]), new_b.where(F.col("release") == r["release"]),
                         r["release"], r["as_of"])
        new_c = c if new_c is None else new_c.unionByName(c)
    if existing is None:
        crawls, backlinks = new_c, new_b
    else:
        crawls, backlinks = upsert_crawls(existing[0], existing[1], new_c, new_b)
    if existing is None:
        _write_crawls(crawls, f"{path}/crawls")
        _rename(spark, staged, f"{path}/backlinks")
        return path
    _write_backlinks(backlinks, f"{path}/backlinks")
    claim = f"{root.rstrip('/')}/_claims/after-{(base or 'none').rstrip('/').split('/')[-1]}"
    if not _claim(spark, claim):
        raise RuntimeError(f"another writer has replaced the version this one started from ({claim}); start again from the newest")
    _write_crawls(crawls, f"{path}/crawls")
    jp, fs = _fs(spark, staged)
    fs.delete(jp, True)
    return path


def write_once(spark: SparkSession, root: str, write) -> str:
    """Materialise a derived table set once under ``root`` and return its folder.

    ``write(path)`` writes everything into a fresh ``v=...`` folder; a ``_COMMITTED``
    marker is created only after it returns. Concurrent or retried callers each write
    their own folder and all read the oldest committed one, so a half-written folder
    (lost executor, killed job) is never read and never overwritten.
    """
    done = _committed_folders(spark, root)
    if done:
        return done[0]
    path = _new_version_path(root)
    write(path)
    jp, fs = _fs(spark, f"{path}/_COMMITTED")
    fs.create(jp, True).close()
    return _committed_folders(spark, root)[0]


def _committed_folders(spark: SparkSession, root: str) -> list[str]:
    jp, fs = _fs(spark, root)
    if not fs.exists(jp):
        return []
    jvm = spark.sparkContext._jvm
    return sorted(st.getPath().toString() for st in fs.listStatus(jp)
                  if st.isDirectory() and st.getPath().getName().startswith("v=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_COMMITTED")))


LOG_CRAWLS_SCHEMA = T.StructType([*CRAWLS_SCHEMA.fields, T.StructField("epoch", T.LongType())])
LOG_BACKLINKS_SCHEMA = T.StructType([*BACKLINKS_SCHEMA.fields, T.StructField("epoch", T.LongType())])
LOG_TABLES = ["crawls", "backlinks"]


def append_crawl_runs(log_root: str, runs: list[dict], n_buckets: int = DEFAULT_BUCKETS) -> int:
    """Q10 + K6 without copying the store: append the runs as one epoch of the crawl log.

    Same layout as the streaming crawl feed (``streaming.crawls``): one part per epoch in
    ``sinks.parts``; ``crawl_log`` gives, per (target, release), the newest epoch -- the replace
    semantics of K6 -- so the cost of a run is the size of the run, not of the store. A part is in force
    from its manifest on, so a run that dies half-way is invisible. Epochs here are millisecond
    stamps; do not mix this writer with a streaming feed (whose epochs are batch ids) on one log.
    """
    spark = runs[0]["vertices"].sparkSession
    root = log_root.rstrip("/")
    epoch = int(time.time() * 1000)
    while not _claim(spark, f"{root}/_claims/epoch-{epoch}"):  # an epoch belongs to one writer
        epoch += 1
    write_crawl_epoch(root, epoch, runs, n_buckets)
    return epoch


def write_crawl_epoch(log_root: str, epoch: int, runs: list[dict], n_buckets: int = DEFAULT_BUCKETS) -> bool:
    """Add the runs as epoch ``epoch`` of a crawl log and merge full levels; an epoch that is there already changes nothing."""
    spark = runs[0]["vertices"].sparkSession
    root = log_root.rstrip("/")

    def write(name: str, _: parts.Manifest) -> None:
        links, targets = None, []
        for r in runs:
            t = normalise_targets(r["targets"])
            targets.append((t, r))
            b = inbound(r["edges"], r["vertices"], t, n_buckets).select(
                "target", F.lit(r["release"]).alias("release"), "linking_domain",
                F.col("num_hosts").cast("long").alias("num_hosts"), F.lit(None).cast("double").alias("page_rank"))
            links = b if links is None else links.unionByName(b)
        stamp = F.lit(epoch).cast("long").alias("epoch")
        _write_clustered(links, lambda df: df.select("*", stamp).write.parquet(parts.folder(root, "backlinks", name)))
        written = parts.read(spark, root, "backlinks", LOG_BACKLINKS_SCHEMA, [parts.Part(name)])
        crawls = None
        for t, r in targets:
            c = crawl_counts(t, written.where(F.col("release") == r["release"]), r["release"], r["as_of"])
            crawls = c if crawls is None else crawls.unionByName(c)
        crawls.select("*", stamp).write.parquet(parts.folder(root, "crawls", name))

    added = parts.add(spark, root, epoch, write)
    compact_crawl_log(spark, root)
    return added


def _newest(spark: SparkSession, root: str, of: list[parts.Part] | tuple[parts.Part, ...]) -> tuple[DataFrame, DataFrame]:
    """(crawls, backlinks) of some parts with their epochs, newest epoch per (target, release)."""
    c = parts.read(spark, root, "crawls", LOG_CRAWLS_SCHEMA, of)
    b = parts.read(spark, root, "backlinks", LOG_BACKLINKS_SCHEMA, of)
    if len(of) == 1:  # one epoch, or merged already
        return c, b
    key = ["target", "release", "epoch"]
    win = c.groupBy("target", "release").agg(F.max("epoch").alias("epoch"))
    return c.join(win, key).select(*c.columns), b.join(win, key).select(*b.columns)


def crawl_log(spark: SparkSession, log_root: str) -> tuple[DataFrame, DataFrame]:
    """(crawls, backlinks) of the log, newest epoch per (target, release); both from one manifest."""
    c, b = _newest(spark, log_root, parts.current(spark, log_root).parts)
    return c.select(*CRAWL_COLS), b.select(*BACKLINK_COLS)


def compact_crawl_log(spark: SparkSession, log_root: str, fanout: int = parts.FANOUT, whole: bool = False) -> None:
    """Merge the parts of full levels (``whole``: all parts); what a newer epoch has replaced is left out."""
    def write(old: list[parts.Part], name: str) -> None:
        c, b = _newest(spark, log_root, old)
        _write_clustered(b, lambda df: df.write.option("compression", "zstd").parquet(parts.folder(log_root, "backlinks", name)))
        c.write.option("compression", "zstd").parquet(parts.folder(log_root, "crawls", name))

    if whole:
        parts.fold(spark, log_root, write)
    else:
        parts.merge(spark, log_root, write, fanout)


def vacuum_crawl_log(spark: SparkSession, log_root: str, keep_seconds: float = parts.KEEP_SECONDS) -> int:
    """Delete merged and abandoned parts that no reader of the last ``keep_seconds`` can use."""
    return parts.vacuum(spark, log_root, LOG_TABLES, keep_seconds)
