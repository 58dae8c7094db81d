"""Parquet sources (S4-S6): graph store, rank tables, crawl store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RANKS_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("harmonic_rank", T.LongType()),
    T.StructField("harmonic_val", T.DoubleType()),
    T.StructField("pr_rank", T.LongType()),
    T.StructField("pr_val", T.DoubleType()),
    T.StructField("n_hosts", T.LongType()),
    T.StructField("dr_score", T.IntegerType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])
MAJESTIC_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("global_rank", T.LongType()),
    T.StructField("tld_rank", T.LongType()),
    T.StructField("ref_subnets", T.LongType()),
    T.StructField("ref_ips", T.LongType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])
TRANCO_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("tranco_rank", T.LongType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])
CRAWLS_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("release", T.StringType()),
    T.StructField("crawled_at", T.TimestampNTZType()),
    T.StructField("result_count", T.LongType()),
])
BACKLINKS_SCHEMA = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("release", T.StringType()),
    T.StructField("linking_domain", T.StringType()),
    T.StructField("num_hosts", T.LongType()),
    T.StructField("page_rank", T.DoubleType()),
])
LOOKUPS_SCHEMA = T.StructType([
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a converted graph store; edges carry the `bucket` partition column."""
    root = root.rstrip("/")
    return spark.read.parquet(f"{root}/vertices"), spark.read.parquet(f"{root}/edges")


def read_raw_edges(spark: SparkSession, path: str) -> DataFrame:
    """An unpartitioned Parquet edge file."""
    return spark.read.parquet(path)


def read_rank_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranks, majestic, tranco), each keyed by domain."""
    root = root.rstrip("/")
    return (spark.read.schema(RANKS_SCHEMA).parquet(f"{root}/ranks"),
            spark.read.schema(MAJESTIC_SCHEMA).parquet(f"{root}/majestic"),
            spark.read.schema(TRANCO_SCHEMA).parquet(f"{root}/tranco"))


def read_crawls(spark: SparkSession, version_path: str) -> DataFrame:
    """Crawls of one store version."""
    return spark.read.schema(CRAWLS_SCHEMA).parquet(f"{version_path.rstrip('/')}/crawls")


def read_backlinks(spark: SparkSession, version_path: str) -> DataFrame:
    """Backlinks of one store version."""
    return spark.read.schema(BACKLINKS_SCHEMA).parquet(f"{version_path.rstrip('/')}/backlinks")
