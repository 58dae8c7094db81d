"""J1-J3, K1-K5, K11, Q9, Q10, K6, K9, W1, A1, A11 on small hand-made graphs."""
import os

import pytest

from pyspark.sql import functions as F

from linkweave.operators.crawls import (crawl_and_store, latest_crawl, list_domains, merge_seed,
                                        upsert_crawls)
from linkweave.operators.dedupe import key_violations
from linkweave.operators.graph import bucket_of, edges_into, inbound, resolve_targets
from linkweave.plans.convert import convert_graph
from linkweave.sinks.layout import store_status, write_edges, write_missing_buckets
from linkweave.sinks.store import latest_version, read_version, write_crawl_runs, write_version
from linkweave.sources.tables import read_graph
from tests.conftest import rows


def _graph(spark):
    vertices = spark.createDataFrame([
        (1, "com.target", 5), (2, "org.linker", 10), (3, "net.other", 0), (4, "com.self", 7),
        (5, "io.github", 100), (6, "com.target2", 1)], "id long, rev_domain string, num_hosts long")
    edges = spark.createDataFrame([
        (2, 1), (2, 1),            # duplicate edge
        (3, 1), (99, 1),           # 99 has no vertex
        (4, 4),                    # self link kept
        (5, 6), (2, 6)], "from_id long, to_id long")
    return vertices, edges


def test_inbound_semantics(spark):
    v, e = _graph(spark)
    t = spark.createDataFrame([("target.com",), ("self.com",), ("unknown.com",)], "target string")
    out = rows(inbound(e, v, t), "target", "linking_domain", "num_hosts")
    assert out == [("self.com", "self.com", 7), ("target.com", "linker.org", 10), ("target.com", "other.net", 0)]


def test_bucket_of_is_non_negative(spark):
    df = spark.createDataFrame([(-7,), (1007,), (0,)], "x long")
    assert [r.b for r in df.select(bucket_of("x", 1000).alias("b")).collect()] == [993, 7, 0]


def test_bucketed_store_prunes_and_answers(spark, tmp_dir):
    v, e = _graph(spark)
    write_edges(e, f"{tmp_dir}/edges", n_buckets=4)
    v.write.parquet(f"{tmp_dir}/vertices")
    vertices, edges = read_graph(spark, tmp_dir)
    assert sorted(x for x in os.listdir(f"{tmp_dir}/edges") if x.startswith("bucket=")) == ["bucket=0", "bucket=1", "bucket=2"]
    t = spark.createDataFrame([("target.com",)], "target string")
    out = inbound(edges, vertices, t, n_buckets=4)
    assert rows(out, "linking_domain") == [("linker.org",), ("other.net",)]
    # A literal bucket predicate becomes a partition filter.
    plan = edges.where((F.col("bucket") == 1) & (F.col("to_id") == 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan


def test_write_missing_buckets_resumes(spark, tmp_dir):
    v, e = _graph(spark)
    write_edges(e.where("to_id = 1"), f"{tmp_dir}/edges", n_buckets=4)
    write_missing_buckets(e, f"{tmp_dir}/edges", n_buckets=4)
    back = spark.read.parquet(f"{tmp_dir}/edges")
    # bucket 1 (to_id 1) is not rewritten; buckets 0 and 2 are added.
    assert back.count() == e.count()
    assert sorted(r.bucket for r in back.select("bucket").distinct().collect()) == [0, 1, 2]


def test_convert_and_status(spark, tmp_dir):
    with open(f"{tmp_dir}/v.txt", "w") as fh:
        fh.write("1\tcom.target\t5\n2\torg.linker\t10\nbad\n")
    with open(f"{tmp_dir}/e.txt", "w") as fh:
        fh.write("2\t1\n1\t2\nx\ty\n")
    out = convert_graph(spark, f"{tmp_dir}/v.txt", f"{tmp_dir}/e.txt", f"{tmp_dir}/store", n_buckets=10)
    s = store_status(spark, out, n_buckets=10).first()
    assert s.available and s.edge_bucket_count == 2 and s.edge_files == 2
    assert s.vertices_parquet_mb is not None and s.edges_total_gb is not None
    # A second run is a no-op on a committed store.
    convert_graph(spark, f"{tmp_dir}/v.txt", f"{tmp_dir}/e.txt", out, n_buckets=10)
    assert spark.read.parquet(f"{out}/edges").count() == 2


def test_crawl_and_store_zero_results_and_invalid(spark):
    v, e = _graph(spark)
    t = spark.createDataFrame([("Target.COM.",), ("unknown.com",), ("bad_name.com",)], "target string")
    c, b = crawl_and_store(t, v, e, "r1", "2026-01-01 00:00:00")
    assert rows(c, "target", "result_count") == [("target.com", 2), ("unknown.com", 0)]
    assert b.where(F.col("page_rank").isNotNull()).count() == 0


def _store(spark):
    c = spark.createDataFrame([
        ("a.com", "r1", "2026-01-01 00:00:00", 2), ("a.com", "r2", "2026-04-01 00:00:00", 1),
        ("b.com", "r1", "2026-01-01 00:00:00", 1)],
        "target string, release string, crawled_at string, result_count long") \
        .withColumn("crawled_at", F.col("crawled_at").cast("timestamp_ntz"))
    b = spark.createDataFrame([
        ("a.com", "r1", "x.org", 3, None), ("a.com", "r1", "y.org", 1, None), ("a.com", "r2", "x.org", 4, None),
        ("b.com", "r1", "z.org", 2, None)],
        "target string, release string, linking_domain string, num_hosts long, page_rank double")
    return c, b


def test_latest_crawl_and_ties(spark):
    c, _ = _store(spark)
    tie = c.unionByName(spark.createDataFrame([("b.com", "r0", "2026-01-01 00:00:00", 9)],
                                              "target string, release string, crawled_at string, result_count long")
                        .withColumn("crawled_at", F.col("crawled_at").cast("timestamp_ntz")))
    assert rows(latest_crawl(tie), "target", "release") == [("a.com", "r2"), ("b.com", "r1")]
    ld = list_domains(c).collect()
    assert [r.domain for r in ld] == ["a.com", "a.com", "b.com"] and {r.total for r in ld} == {3}


def test_upsert_replaces_keys(spark):
    c, b = _store(spark)
    nc = spark.createDataFrame([("a.com", "r1", "2026-05-01 00:00:00", 1)],
                               "target string, release string, crawled_at string, result_count long") \
        .withColumn("crawled_at", F.col("crawled_at").cast("timestamp_ntz"))
    nb = spark.createDataFrame([("a.com", "r1", "new.org", 8, None)],
                               "target string, release string, linking_domain string, num_hosts long, page_rank double")
    c2, b2 = upsert_crawls(c, b, nc, nb)
    assert rows(c2, "target", "release", "result_count") == [("a.com", "r1", 1), ("a.com", "r2", 1), ("b.com", "r1", 1)]
    assert rows(b2.where("target = 'a.com' and release = 'r1'"), "linking_domain") == [("new.org",)]


def test_merge_seed_by_target_only(spark):
    c, b = _store(spark)
    seed_c = spark.createDataFrame([
        ("a.com", "r9", "2026-01-01 00:00:00", 1),          # target known: skipped even with a new release
        ("n.com", "r1", "2026-01-01 00:00:00", 1), ("n.com", "r2", "2026-02-01 00:00:00", 0)],
        "target string, release string, crawled_at string, result_count long") \
        .withColumn("crawled_at", F.col("crawled_at").cast("timestamp_ntz"))
    seed_b = spark.createDataFrame([("a.com", "r9", "q.org", 1, None), ("n.com", "r1", "w.org", 1, None)],
                                   "target string, release string, linking_domain string, num_hosts long, page_rank double")
    mc, mb = merge_seed(c, b, seed_c, seed_b)
    assert rows(mc.where("target = 'n.com'"), "release") == [("r1",), ("r2",)]
    assert mc.where("release = 'r9'").count() == 0 and mb.count() == b.count() + 1


def test_key_violations(spark):
    c, _ = _store(spark)
    dup = c.unionByName(c.where("target = 'b.com'"))
    assert rows(key_violations(dup, ["target", "release"]), "target", "release", "n_rows") == [("b.com", "r1", 2)]


def test_store_versions(spark, tmp_dir):
    c, b = _store(spark)
    root = f"{tmp_dir}/store"
    p1 = write_version(c, b, root)
    assert latest_version(spark, root) == p1 or latest_version(spark, root).endswith(p1.split("/")[-1])
    rc, rb = read_version(spark, latest_version(spark, root))
    assert rc.count() == 3 and rb.count() == 4
    v, e = _graph(spark)
    t = spark.createDataFrame([("target.com",), ("nobody.com",)], "target string")
    p2 = write_crawl_runs(root, [dict(targets=t, vertices=v, edges=e, release="r1", as_of="2026-06-01 00:00:00")],
                          existing=(rc, rb))
    assert latest_version(spark, root).split("/")[-1] == p2.split("/")[-1]
    nc, nb = read_version(spark, p2)
    assert rows(nc, "target", "release", "result_count") == [
        ("a.com", "r1", 2), ("a.com", "r2", 1), ("b.com", "r1", 1), ("nobody.com", "r1", 0), ("target.com", "r1", 2)]


def test_inbound_plan_prunes_buckets_and_never_shuffles_edges(spark, tmp_dir):
    vertices = spark.createDataFrame([(i, f"com.d{i}", i) for i in range(200)], "id long, rev_domain string, num_hosts long")
    e = spark.createDataFrame([(i, (i * 7) % 200) for i in range(2000)], "from_id long, to_id long")
    write_edges(e, f"{tmp_dir}/edges", n_buckets=50)
    vertices.write.parquet(f"{tmp_dir}/vertices")
    vv, ee = read_graph(spark, tmp_dir)
    t = spark.createDataFrame([("d3.com",), ("d9.com",)], "target string")
    df = inbound(ee, vv, t, n_buckets=50)
    assert df.count() == 2   # linkers 29 and 63; ids >= 200 have no vertex and drop out
    # The inbound edges were materialised by a checkpoint; the vertices are streamed past them.
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    into = edges_into(ee, resolve_targets(t, vv), n_buckets=50)
    into.collect()
    plan = into._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(bucket" in plan            # only the targets' buckets are read
    assert "SortMergeJoin" not in plan                           # edges go through broadcast joins only


@pytest.mark.parametrize("n", [2, 50, 1500])
def test_target_lookup_reads_only_the_names_buckets(spark, tmp_dir, n):
    """One path for every list length; the vertex scan is cut to the name buckets of the targets."""
    from linkweave.operators.graph import NAME_BUCKETS
    from linkweave.sinks.layout import write_vertices
    v = spark.range(4000).selectExpr("id", "concat('com.d', id) AS rev_domain", "id AS num_hosts")
    write_vertices(v, f"{tmp_dir}/vertices")
    targets = spark.range(n).selectExpr("concat('d', id, '.com') AS target").unionByName(
        spark.createDataFrame([(None,), ("",), ("nobody.com",)], "target string"))
    found = resolve_targets(targets, spark.read.parquet(f"{tmp_dir}/vertices"))
    assert rows(found, "target_id") == sorted([(i,) for i in range(n)], key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(name_bucket" in plan
    read = _scan_rows(found)
    assert read == 4000 if n > 10 * NAME_BUCKETS else n <= read <= 4000 * min(1, (n + 1) * 3 / NAME_BUCKETS)


def _scan_rows(df):
    """Rows that came out of the plan's file scans (from the metrics of the executed plan)."""
    def walk(node):
        total = 0
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            total += walk(node.children().apply(i))
        return total
    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_lookup_handles_quotes_and_shuffle_joins(spark):
    v = spark.createDataFrame([(1, "com.o'neil", 1), (2, "com.back\\slash", 1), (3, "com.plain", 1)],
                              "id long, rev_domain string, num_hosts long")
    t = spark.createDataFrame([("o'neil.com",), ("back\\slash.com",), ("plain.com",)], "target string")
    want = {("back\\slash.com", 2), ("o'neil.com", 1), ("plain.com", 3)}
    assert set(rows(resolve_targets(t, v), "target", "target_id")) == want
    assert set(rows(resolve_targets(t, v, max_broadcast_rows=0), "target", "target_id")) == want


def test_smallness_is_counted_not_estimated(spark):
    from linkweave.operators.joins import broadcast_if_small, is_small
    exploded = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(300_000))).alias("x"))
    assert not is_small(exploded) and is_small(exploded, 300_000)
    assert "BroadcastHint" not in broadcast_if_small(exploded)._jdf.queryExecution().analyzed().toString()


def test_resume_replaces_half_written_buckets(spark, tmp_dir):
    e = spark.createDataFrame([(i, i % 4) for i in range(40)] + [(100, None)], "from_id long, to_id long")
    path = f"{tmp_dir}/edges"
    write_edges(e.where("to_id = 0"), path, 4)                                       # bucket 0 is complete
    e.where("to_id = 1 AND from_id < 16").select("from_id", "to_id", F.lit(1).alias("bucket")) \
        .write.mode("append").partitionBy("bucket").parquet(path)                     # bucket 1 is half written
    for _ in range(3):
        write_missing_buckets(e, path, 4)
        back = spark.read.schema("from_id long, to_id long, bucket int").parquet(path)
        assert rows(back, "from_id", "to_id") == rows(e, "from_id", "to_id")


def test_resume_after_a_run_that_left_only_a_task_folder(spark, tmp_dir):
    e = spark.createDataFrame([(i, i % 4) for i in range(12)], "from_id long, to_id long")
    os.makedirs(f"{tmp_dir}/edges/_temporary/0")
    write_missing_buckets(e, f"{tmp_dir}/edges", 4)
    assert spark.read.parquet(f"{tmp_dir}/edges").count() == 12


def test_status_of_missing_and_incomplete_stores(spark, tmp_dir):
    s = store_status(spark, f"{tmp_dir}/nothing", n_buckets=4).first()
    assert (s.available, s.edge_bucket_count, s.vertices_parquet_mb, s.edges_total_gb) == (False, 0, None, None)
    with open(f"{tmp_dir}/v.txt", "w") as fh:
        fh.write("1\tcom.a\t5\n2\tcom.b\t10\n")
    with open(f"{tmp_dir}/e.txt", "w") as fh:
        fh.write("2\t1\n1\t2\n")
    out = convert_graph(spark, f"{tmp_dir}/v.txt", f"{tmp_dir}/e.txt", f"{tmp_dir}/store", n_buckets=4)
    assert store_status(spark, out, n_buckets=4).first().available
    assert not store_status(spark, out, n_buckets=8).first().available        # another layout
    for f in os.listdir(f"{out}/edges/bucket=1"):
        os.remove(f"{out}/edges/bucket=1/{f}")
    assert not store_status(spark, out, n_buckets=4).first().available        # a recorded bucket has lost its files


def test_ensure_crawled_only_crawls_new_targets(spark):
    from linkweave.plans.reports import ensure_crawled
    v, e = _graph(spark)
    c, b = _store(spark)
    t = spark.createDataFrame([("a.com",), ("TARGET.com",)], "target string")
    c2, b2 = ensure_crawled(t, c, b, v, e, "r5", "2026-07-01 00:00:00")
    assert rows(c2, "target", "release", "result_count") == [
        ("a.com", "r1", 2), ("a.com", "r2", 1), ("b.com", "r1", 1), ("target.com", "r5", 2)]
    assert b2.count() == b.count() + 2


def test_invalid_domains_and_compaction(spark, tmp_dir):
    from linkweave.functions import invalid_domains
    from linkweave.sinks.layout import append_lookups, compact
    t = spark.createDataFrame([("ok.com",), ("bad_name.com",), ("http://x.com",)], "target string")
    assert rows(invalid_domains(t), "target") == [("bad_name.com",), ("http://x.com",)]
    df = spark.range(100).select((F.col("id") % 3).cast("int").alias("bucket"), "id").repartition(7)
    compact(df, f"{tmp_dir}/compact")
    for bkt in range(3):
        files = [x for x in os.listdir(f"{tmp_dir}/compact/bucket={bkt}") if x.endswith(".parquet")]
        assert len(files) == 1
    lk = spark.createDataFrame([("a", "b", "c.com", "", "", "", "")],
                               "first_name string, last_name string, domain string, email string, confidence string, title string, company string")
    append_lookups(lk, f"{tmp_dir}/lookups")
    append_lookups(lk, f"{tmp_dir}/lookups")
    assert spark.read.parquet(f"{tmp_dir}/lookups").count() == 2


def test_duplicate_vertex_names_all_contribute(spark):
    # Two ids share a name -> both ids' inbound edges count; a linker reached twice appears once.
    v = spark.createDataFrame([(1, "com.t", 1), (7, "com.t", 1), (2, "org.a", 5), (3, "org.a", 9), (4, "org.b", 2)],
                              "id long, rev_domain string, num_hosts long")
    e = spark.createDataFrame([(2, 1), (3, 7), (4, 7)], "from_id long, to_id long")
    t = spark.createDataFrame([("t.com",)], "target string")
    for limit in (10, 0):   # broadcast joins and shuffle joins
        got = rows(inbound(e, v, t, max_broadcast_rows=limit), "target", "linking_domain", "num_hosts")
        assert got == [("t.com", "a.org", 9), ("t.com", "b.org", 2)]


def test_write_once_ignores_half_written_folders(spark, tmp_dir):
    from linkweave.sinks.store import write_once
    root = f"{tmp_dir}/once"
    os.makedirs(f"{root}/v=000000000000001-dead")          # a crashed writer left this behind
    calls = []

    def write(path):
        calls.append(path)
        spark.range(3).write.parquet(f"{path}/t")

    first = write_once(spark, root, write)
    again = write_once(spark, root, write)
    assert first == again and len(calls) == 1 and "dead" not in first
    assert spark.read.parquet(f"{first}/t").count() == 3


def test_overwrite_of_own_input_is_refused(spark, tmp_dir):
    import pytest
    from linkweave.sinks.layout import write_ranks
    df = spark.createDataFrame([("a.com", 1)], "domain string, harmonic_rank long")
    write_ranks(df, f"{tmp_dir}/ranks")
    back = spark.read.parquet(f"{tmp_dir}/ranks")
    with pytest.raises(ValueError, match="refusing to overwrite"):
        write_ranks(back.where("harmonic_rank > 0"), f"{tmp_dir}/ranks")
    assert spark.read.parquet(f"{tmp_dir}/ranks").count() == 1
    write_ranks(back, f"{tmp_dir}/ranks2")
    assert spark.read.parquet(f"{tmp_dir}/ranks2").count() == 1


def test_append_crawl_runs_replaces_by_key_without_copying(spark, tmp_dir):
    from linkweave.sinks.store import append_crawl_runs
    from linkweave.streaming.crawls import read_crawl_log
    v, e = _graph(spark)
    log = f"{tmp_dir}/log"
    t1 = spark.createDataFrame([("target.com",), ("self.com",)], "target string")
    append_crawl_runs(log, [dict(targets=t1, vertices=v, edges=e, release="r1", as_of="2026-01-01 00:00:00")])
    e2 = e.where("from_id <> 3")                                  # the graph changed
    t2 = spark.createDataFrame([("target.com",)], "target string")
    append_crawl_runs(log, [dict(targets=t2, vertices=v, edges=e2, release="r1", as_of="2026-02-01 00:00:00")])
    c, b = read_crawl_log(spark, log)
    assert rows(c, "target", "result_count") == [("self.com", 1), ("target.com", 1)]
    assert rows(b.where("target = 'target.com'"), "linking_domain") == [("linker.org",)]


def test_two_writers_of_one_store(spark, tmp_dir):
    from linkweave.sinks.store import append_crawl_runs, read_latest
    from linkweave.streaming.crawls import read_crawl_log
    v, e = _graph(spark)
    run = lambda name, day: [dict(targets=spark.createDataFrame([(name,)], "target string"), vertices=v, edges=e,
                                  release="r1", as_of=f"2026-01-0{day} 00:00:00")]
    root = f"{tmp_dir}/store"
    write_crawl_runs(root, run("self.com", 1))
    base = read_latest(spark, root)
    import linkweave.sinks.store as store
    real = store.latest_version
    start = real(spark, root)
    store.latest_version = lambda *_: start          # both writers start from the first version
    try:
        write_crawl_runs(root, run("target.com", 2), existing=base)
        with pytest.raises(RuntimeError, match="another writer"):
            write_crawl_runs(root, run("unknown.com", 3), existing=base)
    finally:
        store.latest_version = real
    assert rows(read_latest(spark, root)[0], "target") == [("self.com",), ("target.com",)]
    write_crawl_runs(root, run("unknown.com", 3), existing=read_latest(spark, root))
    assert rows(read_latest(spark, root)[0], "target") == [("self.com",), ("target.com",), ("unknown.com",)]

    log, real_time = f"{tmp_dir}/log", store.time.time
    store.time.time = lambda: 1.0                     # the same millisecond
    try:
        epochs = [append_crawl_runs(log, run(n, 4)) for n in ("self.com", "target.com")]
    finally:
        store.time.time = real_time
    assert epochs == [1000, 1001] and rows(read_crawl_log(spark, log)[0], "target") == [("self.com",), ("target.com",)]
