"""Graph store layout and table writers.

Edges are written under ``edges/bucket=<to_id mod n>/`` (a Hive-style partition
column, so a predicate or join on `bucket` prunes directories). One shuffle by
bucket replaces the staging file and the per-bucket compaction passes: the
rebalance hint gives one file per bucket, and AQE splits a bucket that is far
larger than the advisory partition size into several files instead of sending
a hot bucket through a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.timekeys import bytes_to
from linkweave.operators.graph import DEFAULT_BUCKETS, bucket_of, name_bucket_of
from linkweave.sinks import parts
from linkweave.sources.tables import MAJESTIC_SCHEMA, RANKS_SCHEMA, TRANCO_SCHEMA

PARQUET_OPTIONS = {"compression": "zstd"}


def _fs(spark: SparkSession, path: str):
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jp, jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    jp, fs = _fs(spark, path)
    return bool(fs.exists(jp))


def _refuse_self_overwrite(df: DataFrame, path: str) -> None:
    """Overwriting a folder the plan itself reads deletes the input mid-job (data loss); refuse it.

    Only the root folders of the plan's scans are compared, never the list of files.
    """
    jp, fs = _fs(df.sparkSession, path)
    target = fs.makeQualified(jp).toUri().toString().rstrip("/")
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or not hasattr(leaf.relation(), "location"):
            continue
        roots = leaf.relation().location().rootPaths()
        for j in range(roots.size()):
            root = roots.apply(j).toUri().toString().rstrip("/")
            root = root if ":" in root.split("/")[0] else "file:" + root
            if (root + "/").startswith(target + "/") or (target + "/").startswith(root + "/"):
                raise ValueError(f"refusing to overwrite {path}: the DataFrame reads from it; write a new folder")


def _writer(df: DataFrame, mode: str, path: str | None = None):
    if mode == "overwrite" and path is not None:
        _refuse_self_overwrite(df, path)
    w = df.write.mode(mode)
    for k, v in PARQUET_OPTIONS.items():
        w = w.option(k, v)
    return w


def _with_bloom(writer, column: str):
    """A Parquet Bloom filter on ``column``, as large as the row group's values need."""
    return (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            .option(f"parquet.bloom.filter.adaptive.enabled#{column}", "true"))


def write_vertices(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: vertices as ZSTD Parquet under ``name_bucket=<hash of the name>/``, sorted by rev_domain.

    A join on (name_bucket, rev_domain) reads only the directories of the names asked for,
    and row groups that cannot hold them are skipped by their minimum and maximum. Names given as
    literals are also looked up in a Bloom filter per row group, so a name that is not there costs footers only.
    """
    v = df.select("id", "rev_domain", "num_hosts", name_bucket_of(F.col("rev_domain")).alias("name_bucket"))
    v = v.hint("rebalance", "name_bucket").sortWithinPartitions("name_bucket", "rev_domain")
    _with_bloom(_writer(v, mode, path), "rev_domain").partitionBy("name_bucket").parquet(path)


def with_bucket(edges: DataFrame, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """F10 as a column on an edge table."""
    return edges.select("from_id", "to_id", bucket_of("to_id", n_buckets).alias("bucket"))


def _bucketed(b: DataFrame) -> DataFrame:
    return b.hint("rebalance", "bucket").sortWithinPartitions("bucket", "to_id", "from_id")


def write_edges(edges: DataFrame, path: str, n_buckets: int = DEFAULT_BUCKETS, mode: str = "errorifexists") -> None:
    """K2-K4: edges partitioned by bucket, one (or, for a huge bucket, a few) sorted file(s) each.

    When the edges are committed, the buckets are recorded with their row counts (see ``recorded_buckets``).
    """
    _writer(_bucketed(with_bucket(edges, n_buckets)), mode, path).partitionBy("bucket").parquet(path)
    _record(edges.sparkSession, path, n_buckets, None)


def _record_path(path: str) -> str:
    return path.rstrip("/") + "_buckets"


def _record(spark: SparkSession, path: str, n_buckets: int, done: DataFrame | None) -> None:
    counts = _edges_at(spark, path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_edges"))
    if done is not None:
        counts = counts.join(F.broadcast(done), counts["bucket"].eqNullSafe(done["done"]), "left_anti")
    counts = counts.withColumn("n_buckets", F.lit(n_buckets))
    counts.coalesce(1).write.mode("append" if done is not None else "overwrite").parquet(_record_path(path))


def _edges_at(spark: SparkSession, path: str) -> DataFrame:
    """Committed edges; the schema is given, so a folder without any file is an empty table."""
    return spark.read.schema("from_id long, to_id long, bucket int").parquet(path)


def recorded_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Buckets that are completely written: (bucket, n_edges, n_buckets), at most one row per bucket.

    The record is written after the bucket's files are committed, so a bucket that a lost
    driver left half written is not in it.
    """
    schema = "bucket int, n_edges long, n_buckets int"
    if not _exists(spark, _record_path(path) + "/_SUCCESS"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_record_path(path))


def write_missing_buckets(edges: DataFrame, path: str, n_buckets: int = DEFAULT_BUCKETS) -> None:
    """K5: resume a conversion -- write every bucket that is not recorded as complete.

    Directories of those buckets are replaced as a whole (dynamic partition overwrite), so
    what an interrupted run left in them is neither kept nor doubled; a NULL target's bucket is
    a bucket like any other. The record holds at most n_buckets + 1 rows, so it is broadcast.
    """
    spark = edges.sparkSession
    done = recorded_buckets(spark, path).select(F.col("bucket").alias("done"))
    todo = with_bucket(edges, n_buckets)
    todo = todo.join(F.broadcast(done), todo["bucket"].eqNullSafe(done["done"]), "left_anti")
    w = _bucketed(todo.select("from_id", "to_id", "bucket")).write.mode("overwrite")
    for k, v in PARQUET_OPTIONS.items():
        w = w.option(k, v)
    w.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    _record(spark, path, n_buckets, done)


def compact(df: DataFrame, path: str, by: str = "bucket", mode: str = "errorifexists") -> None:
    """K4 on its own: rewrite a partitioned table with one file per partition value."""
    _writer(df.hint("rebalance", by), mode, path).partitionBy(by).parquet(path)


def write_ranks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K7: (re)create a rank table; sorted by domain so domain lookups prune row groups."""
    _with_bloom(_writer(df.repartitionByRange("domain").sortWithinPartitions("domain"), mode, path), "domain").parquet(path)


RANK_TABLES = {"ranks": RANKS_SCHEMA, "majestic": MAJESTIC_SCHEMA, "tranco": TRANCO_SCHEMA}


def publish_rank_tables(root: str, tables: dict[str, DataFrame]) -> parts.Manifest:
    """K7: put new rank tables in force in one step (all of ``tables`` together).

    The tables are written aside and one manifest switches to them, so a reader sees the old tables or the new
    ones, whole, also one that started before and ends after the switch. Raises if another writer has published meanwhile.
    A table that is not given is empty from then on.
    """
    spark = next(iter(tables.values())).sparkSession

    def write(name: str) -> None:
        for table, df in tables.items():
            rows = df.select(*RANK_TABLES[table].fieldNames()).repartitionByRange("domain").sortWithinPartitions("domain")
            _with_bloom(rows.write.option("compression", "zstd"), "domain").parquet(parts.folder(root, table, name))

    return parts.replace(spark, root, write)


def read_published_ranks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranks, majestic, tranco) of one publication."""
    now = parts.current(spark, root).parts
    ranks, majestic, tranco = (parts.read(spark, root, table, schema, now) for table, schema in RANK_TABLES.items())
    return ranks, majestic, tranco


def append_lookups(df: DataFrame, path: str) -> None:
    """Append contact lookups (positive and negative) to the cache table."""
    _writer(df, "append").parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Size, time and bucket of the Parquet files under a folder; none if it is not there."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "length long, modificationTime timestamp, bucket int")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").load(path)
            .select("length", "modificationTime",
                    F.regexp_extract("path", r"/bucket=(\d+)/", 1).try_cast("int").alias("bucket")))


def store_status(spark: SparkSession, root: str, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """One status row for a graph store.

    File listing is done by Spark (only path, size and time; file contents are
    never read). ``available`` needs a committed vertex table, committed edges with a
    bucket record of the same ``n_buckets``, and files for every recorded bucket. A store
    that is not there is not available and has NULL sizes.
    """
    root = root.rstrip("/")
    committed = all(_exists(spark, f"{root}/{p}/_SUCCESS") for p in ("vertices", "edges", "edges_buckets"))
    vfiles, efiles = _files(spark, f"{root}/vertices"), _files(spark, f"{root}/edges")
    recorded = recorded_buckets(spark, f"{root}/edges").where("bucket IS NOT NULL")
    missing = recorded.join(efiles.select("bucket").distinct(), "bucket", "left_anti")
    e = efiles.agg(F.count(F.lit(1)).alias("edge_files"), F.count_distinct("bucket").alias("edge_bucket_count"),
                   F.sum("length").alias("e_bytes"), F.max("modificationTime").alias("e_mtime"))
    v_bytes = vfiles.agg(F.sum("length")).scalar()
    lost = missing.agg(F.count(F.lit(1))).scalar()
    other_layout = recorded.where(F.col("n_buckets") != n_buckets).agg(F.count(F.lit(1))).scalar()
    return e.select(
        (F.lit(committed) & (F.col("edge_bucket_count") > 0) & (lost == 0) & (other_layout == 0)).alias("available"),
        bytes_to(v_bytes, "MB", 1).alias("vertices_parquet_mb"),
        F.col("edge_bucket_count"),
        F.col("edge_files"),
        bytes_to(F.col("e_bytes"), "GB", 2).alias("edges_total_gb"),
        (F.unix_timestamp(F.col("e_mtime")).cast("double")).alias("edges_last_modified_unix"),
    )
