"""The number of tasks of the graph joins and of the crawl store grows with the rows, whatever the session's own number is."""

from __future__ import annotations

import glob
import os

from linkweave.operators import joins
from linkweave.operators.graph import inbound, only_listed
from linkweave.sinks.store import crawl_log, write_crawl_epoch
from pyspark.sql import functions as F


def graph(spark, n: int):
    """``n`` linkers of four targets."""
    v = spark.range(n + 4).select("id", F.concat(F.lit("com.v"), F.col("id")).alias("rev_domain"), (F.col("id") % 9).alias("num_hosts"))
    e = (spark.range(4).select(F.col("id").alias("to_id")).crossJoin(spark.range(4, n + 4).select(F.col("id").alias("from_id")))
         .select("from_id", "to_id"))
    t = spark.range(4).select(F.concat(F.lit("v"), F.col("id"), F.lit(".com")).alias("target"))
    return v, e, t


def test_inbound_groups_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 100)
    v, e, t = graph(spark, 1500)
    out = inbound(e.union(e.where("from_id < 10")), v, t, max_broadcast_rows=10)
    assert out.rdd.getNumPartitions() == 61  # 6,024 edges
    rows = {(r.target, r.linking_domain): r.num_hosts for r in out.collect()}
    assert len(rows) == 6000 and rows["v2.com", "v20.com"] == 2 and out.count() == 6000


def test_an_epoch_is_written_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 100)
    v, e, t = graph(spark, 1000)
    root = f"{tmp_path}/log"
    write_crawl_epoch(root, 0, [dict(targets=t, vertices=v, edges=e, release="r", as_of=None)])
    files = [f for f in glob.glob(f"{root}/**/*.parquet", recursive=True) if "backlinks" in f]
    assert len(files) >= 38 and all(os.path.getsize(f) for f in files)  # 4,000 rows in ranges of about 100
    crawls, backlinks = crawl_log(spark, root)
    assert backlinks.distinct().count() == backlinks.count() == 4000
    assert {(r.target, r.result_count) for r in crawls.collect()} == {(f"v{i}.com", 1000) for i in range(4)}


def test_no_filter_where_most_rows_are_listed(spark):
    df = spark.range(10_000).select(F.col("id").alias("k"))
    plan = lambda ids: only_listed(df, "k", ids)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(df.where("k % 2 = 0"))
    assert "Join" in plan(df.where("k % 100 = 0"))
