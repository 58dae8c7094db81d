"""Q9: graph conversion -- text dumps to a bucketed Parquet store.

One pass and one shuffle: the edge dump is parsed in parallel (a single gzip
file is re-spread right after its scan), bucketed by `to_id mod n` and written
with one file per bucket. Re-running resumes: a committed vertex table is kept
and only edge buckets that are not recorded as complete are written.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from linkweave.operators.graph import DEFAULT_BUCKETS
from linkweave.sinks.layout import write_edges, write_missing_buckets, write_vertices
from linkweave.sources.text import read_edges, read_vertices


def _exists(spark: SparkSession, path: str) -> bool:
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jp))


def convert_graph(spark: SparkSession, vertices_src: str, edges_src: str, out: str,
                  n_buckets: int = DEFAULT_BUCKETS, partitions: int | None = None) -> str:
    out = out.rstrip("/")
    if not _exists(spark, f"{out}/vertices/_SUCCESS"):
        write_vertices(read_vertices(spark, vertices_src, partitions=partitions), f"{out}/vertices", mode="overwrite")
    edges = read_edges(spark, edges_src, partitions=partitions)
    if _exists(spark, f"{out}/edges/_SUCCESS") and _exists(spark, f"{out}/edges_buckets/_SUCCESS"):
        return out
    if _exists(spark, f"{out}/edges"):
        write_missing_buckets(edges, f"{out}/edges", n_buckets)
    else:
        write_edges(edges, f"{out}/edges", n_buckets)
    return out
