"""Point lookups through Bloom filters, the bit filter of long target lists, gap counts on words of ids, sizes of the status."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators.gap import gap, gap_summary, linker_sets
from linkweave.operators.graph import MAX_LITERAL_NAMES, inbound, only_listed, resolve_targets
from linkweave.plans.convert import convert_graph
from linkweave.sinks.layout import append_lookups, store_status, write_ranks, write_vertices
from tests.conftest import rows
from tests.test_graph_and_store import _scan_rows


def _names(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("com.n"), F.format_string("%06d", F.col("id") * 2)).alias("rev_domain"),
                                 F.lit(1).cast("long").alias("num_hosts"))


def test_names_that_are_not_there_read_no_rows(spark, tmp_dir):
    write_vertices(_names(spark, 20_000), f"{tmp_dir}/v")
    v = spark.read.parquet(f"{tmp_dir}/v")
    absent = [f"com.n{i * 2 + 1:06d}" for i in range(100, 1100, 100)]
    assert _scan_rows(v.where(F.col("rev_domain").isin(absent))) == 0
    assert 0 < _scan_rows(v.where(F.col("rev_domain") == "com.n000200")) < 400
    write_ranks(_names(spark, 20_000).withColumnRenamed("rev_domain", "domain"), f"{tmp_dir}/r")
    assert _scan_rows(spark.read.parquet(f"{tmp_dir}/r").where("domain = 'com.n000201'")) == 0


def test_a_few_targets_go_to_the_scan_as_literals(spark, tmp_dir):
    write_vertices(_names(spark, 20_000), f"{tmp_dir}/v")
    v = spark.read.parquet(f"{tmp_dir}/v")
    for n, pushed in ((3, True), (MAX_LITERAL_NAMES, True), (MAX_LITERAL_NAMES + 1, False), (0, True)):
        t = spark.createDataFrame([(f"n{i * 2 + (i % 2):06d}.com",) for i in range(100, 100 + n)], "target string")
        found = resolve_targets(t, v)
        assert sorted(r.target_id for r in found.collect()) == [i for i in range(100, 100 + n) if i % 2 == 0]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("rev_domain#" in plan and ("In(rev_domain" in plan or "EqualTo(rev_domain" in plan) or n == 0) == pushed


@pytest.mark.parametrize("bits", [8, 16, 26])
def test_the_bit_filter_loses_no_listed_row(spark, bits):
    ids = spark.range(0, 5000, 100).select(F.col("id").alias("k")).union(spark.range(3).select(F.lit(-7).cast("long").alias("k")))
    df = spark.range(-10, 5000).select(F.col("id").alias("k"), F.col("id").alias("_word_"))
    kept = {r.k for r in only_listed(df, "k", ids, bits).collect()}
    assert {*range(0, 5000, 100), -7} <= kept and (bits < 10 or len(kept) < 120)
    assert only_listed(df, "k", df.select("k"), 8).count() == df.count()  # too many for the filter: left alone


def test_long_lists_shuffle_only_the_linkers(spark):
    v = spark.range(20_000).select("id", F.concat(F.lit("com.v"), F.col("id")).alias("rev_domain"), F.lit(2).cast("long").alias("num_hosts"))
    e = spark.range(400).select((F.col("id") % 200 + 1000).alias("from_id"), (F.col("id") % 40).alias("to_id"))
    t = spark.range(40).select(F.concat(F.lit("v"), F.col("id"), F.lit(".com")).alias("target"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = inbound(e, v, t, max_broadcast_rows=20)
        found = rows(got, "target", "linking_domain")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "getbit" in plan.lower() and "SortMergeJoin" in plan
        assert _shuffled(got) < 3 * 400 + 400  # not the 20,000 vertices
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == rows(inbound(e, v, t), "target", "linking_domain")


def _shuffled(df):
    """Rows that the plan's exchanges have written."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        total = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return total + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_gap_counts_equal_the_gap_rows(spark):
    rnd = random.Random(4)
    links = [(f"t{t}.com", f"d{d}.org") for t in range(12) for d in rnd.sample(range(400), rnd.choice([0, 1, 5, 200]))]
    links += [("t0.com", f"only{i}.org") for i in range(30)]
    when = F.lit("2026-01-01").cast("timestamp_ntz").alias("crawled_at")
    c = spark.range(12).select(F.concat(F.lit("t"), F.col("id"), F.lit(".com")).alias("target"), F.lit("r").alias("release"), when,
                               F.lit(0).cast("long").alias("result_count"))
    b = spark.createDataFrame([(t, "r", d, 1, None) for t, d in links + links[:50]] + [("t0.com", "old", "d1.org", 1, None)],
                              "target string, release string, linking_domain string, num_hosts long, page_rank double")
    pairs = spark.createDataFrame([(f"T{x}.com", f"t{y}.COM.") for x, y in itertools.product(range(12), range(12))] + [("t1.com", "never.com")],
                                  "yours string, competitor string")
    sets = {f"t{t}.com": {d for x, d in links if x == f"t{t}.com"} for t in range(12)}
    want = sorted((x, y, len(sets[x]), len(sets[y]), len(sets[y] - sets[x])) for x in sets for y in sets)
    empty = spark.createDataFrame([], "domain string, global_rank long, tld_rank long, ref_subnets long, ref_ips long, tranco_rank long")
    found = gap_summary(pairs, c, b)
    assert rows(found, "yours", "competitor", "your_backlinks", "competitor_backlinks", "gap_count") == sorted(want, key=repr)
    listed = gap(pairs, c, b, empty.drop("tranco_rank"), empty.select("domain", "tranco_rank"))
    counted = {(r.yours, r.competitor): r.n for r in listed.select("yours", "competitor", "domain").distinct()
               .groupBy("yours", "competitor").agg(F.count("*").alias("n")).collect()}
    assert counted == {(x, y): n for x, y, _, _, n in want if n}


def test_gap_summary_scans_the_backlinks_once(spark, tmp_dir):
    b = spark.createDataFrame([("a.com", "r", "x.org", 1, None), ("b.com", "r", "x.org", 1, None), ("b.com", "r", "y.org", 1, None)],
                              "target string, release string, linking_domain string, num_hosts long, page_rank double")
    b.write.parquet(f"{tmp_dir}/backlinks")
    c = spark.createDataFrame([("a.com", "r", 1), ("b.com", "r", 2)], "target string, release string, result_count long").withColumn(
        "crawled_at", F.lit("2026-01-01").cast("timestamp_ntz"))
    pairs = spark.createDataFrame([("a.com", "b.com")], "yours string, competitor string")
    out = gap_summary(pairs, c, spark.read.parquet(f"{tmp_dir}/backlinks"))
    # the only job that reads them has written the link sets already
    assert f"{tmp_dir}/backlinks" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "your_backlinks", "competitor_backlinks", "gap_count") == [(1, 2, 1)]


def test_status_sizes_are_the_sizes_of_the_files(spark, tmp_dir):
    with open(f"{tmp_dir}/v.txt", "w") as fh:
        fh.writelines(f"{i}\tcom.name{i * 7919 % 100_003}\t{i % 50}\n" for i in range(120_000))
    with open(f"{tmp_dir}/e.txt", "w") as fh:
        fh.writelines(f"{i % 90_001}\t{i * 31 % 120_000}\n" for i in range(300_000))
    out = convert_graph(spark, f"{tmp_dir}/v.txt", f"{tmp_dir}/e.txt", f"{tmp_dir}/store", n_buckets=10)
    s = store_status(spark, out, n_buckets=10).first()

    def size(table):
        files = spark.read.parquet(f"{out}/{table}").select("_metadata.file_path", "_metadata.file_size").distinct()
        return files.agg(F.sum("file_size")).first()[0], files.count()

    (v_bytes, _), (e_bytes, e_files) = size("vertices"), size("edges")
    assert s.vertices_parquet_mb == round(v_bytes / 2**20, 1) > 0 and s.edges_total_gb == round(e_bytes / 2**30, 2)
    assert s.edge_files == e_files == 10


def test_lookups_are_appended(spark, tmp_dir):
    row = spark.createDataFrame([("A", "B", "c.com", "", "", "", "")], "first_name string, last_name string, domain string, email string, "
                                "confidence string, title string, company string").withColumn("created_at", F.lit("2026-01-01").cast("timestamp_ntz"))
    for n in (1, 2):
        append_lookups(row, f"{tmp_dir}/lookups")
        assert spark.read.parquet(f"{tmp_dir}/lookups").count() == n


def test_gap_summary_keeps_sparse_linker_sets_small(spark):
    """Sets of few linkers out of many cost a short row per linker, not a whole bitmap per range of ids."""
    n = 70_000
    link = lambda t: F.concat(F.lit("l"), t.cast("string"))
    ids = spark.range(n)
    backlinks = (ids.select(F.lit("all.com").alias("target"), link(F.col("id")).alias("linking_domain"))
                 .union(ids.where("id % 7000 = 0").select(F.lit("few.com"), link(F.col("id"))))
                 .union(ids.where("id % 10000 = 0").select(F.lit("other.com"), link(F.col("id"))))
                 .union(spark.range(1).select(F.lit("few.com"), F.lit("own.com")))
                 .select("target", F.lit("r").alias("release"), "linking_domain"))
    names = ["all.com", "few.com", "other.com"]
    crawls = spark.createDataFrame([(t, "r", 1, 1) for t in names], "target string, release string, crawled_at int, result_count long")
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "yours string, competitor string")
    got = {(r.yours, r.competitor): (r.your_backlinks, r.competitor_backlinks, r.gap_count) for r in gap_summary(pairs, crawls, backlinks).collect()}
    size = {"all.com": n, "few.com": 11, "other.com": 7}
    gaps = {("all.com", "few.com"): 1, ("all.com", "other.com"): 0, ("few.com", "all.com"): n - 10, ("few.com", "other.com"): 6,
            ("other.com", "all.com"): n - 7, ("other.com", "few.com"): 10}
    assert got == {(a, b): (size[a], size[b], 0 if a == b else gaps[a, b]) for a in names for b in names}
    resolved = pairs.withColumns({"yours_release": F.lit("r"), "competitor_release": F.lit("r")})
    _, sets = linker_sets(resolved, backlinks, True)
    few = sets.where("target = 'other.com'").agg(F.sum(sum((F.length(F.col(c).cast("binary")) if t == "binary" else F.lit(8))
                                                           for c, t in sets.dtypes if c != "target"))).first()[0]
    assert few <= 7 * 16
