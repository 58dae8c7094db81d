"""Reading the input tables and small shared helpers of the training-data operators."""

from __future__ import annotations

import io
import pathlib
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import linkweave
from linkweave.llm.words import give_back
from linkweave.session import materialize, scratch_path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver was started from.

    Once per application the package's sources go as a zip to the shared scratch folder,
    and Spark adds it to the workers' path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(linkweave.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = scratch_path(spark, "package") + ".zip"
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jp)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash_fold(id_col: str, modulo: int) -> Column:
    """crc32 of the id's text modulo ``modulo`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulo)


FILTER_BITS = 27


def filter_place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def id_filter(places: DataFrame) -> np.ndarray:
    """A bit per listed place (column ``place``, below 2 ** FILTER_BITS), in 2 ** FILTER_BITS bits (16 MB) however many ids there are.

    A task that holds the filter can leave out most rows that are not listed; rows that
    pass by chance must be sorted out by a join afterwards.
    """
    rows = (places.groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    del rows
    give_back()  # the driver makes many filters
    return out


def passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: one row ``(node, component)`` per node on an edge,
    ``component`` the smallest node reachable.

    Alternates the large-star and small-star steps; every step is a grouped
    minimum and a join, so no component is ever gathered in one task. Each round
    is written to the shared scratch folder, which cuts the lineage. Done when no node that others
    point to points to a smaller one itself.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct(), f"{name}-0")
    for i in range(1, 200):
        # stars: every node points to one node, which points nowhere
        ends = (cur.select(F.col("u").alias("node"), F.col("v").alias("too"))
                .union(cur.select(F.col("v").alias("node"), F.lit(None).alias("too"))))
        seen = ends.groupBy("node").agg(F.min("too").alias("m"), F.max("too").alias("far"), F.max(F.col("too").isNull()).alias("end"))
        if seen.where("m <> far OR (m IS NOT NULL AND end)").isEmpty():
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", F.col("m").alias("v")))
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        cur = materialize(small, f"{name}-{i}")
    else:
        raise RuntimeError("components have not settled in 199 rounds")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.union(roots)


def joined_components(found: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """Components ``(node, component)`` after more ``links(a, b)``: only the components so far are joined, not their nodes."""
    if found is None:
        return materialize(components(links, name), f"{name}-found")
    if links.isEmpty():
        return found
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    known = found.union(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = components(between, name).select(F.col("node").alias("component"), F.col("component").alias("smallest"))
    return materialize(known.join(joined, "component", "left").select("node", F.coalesce("smallest", "component").alias("component")),
                       f"{name}-found")
