"""Q1-Q4 reports: enrichment, bundle, preview (T17), gap (T10, T13), nesting."""
from pyspark.sql import functions as F

from linkweave.operators.gap import gap, gap_missing, gap_summary, order_gap
from linkweave.plans.reports import backlinks_report, bundle_report, nested_report, preview_report
from tests.conftest import rows

TS = "timestamp_ntz"


def _crawls(spark, data):
    return spark.createDataFrame(data, "target string, release string, crawled_at string, result_count long") \
        .withColumn("crawled_at", F.col("crawled_at").cast(TS))


def _links(spark, data):
    return spark.createDataFrame([(t, r, d, n, None) for t, r, d, n in data],
                                 "target string, release string, linking_domain string, num_hosts long, page_rank double")


def _ranks(spark, data):
    return spark.createDataFrame([(d, h, 1.0, h, pv, n, dr, None) for d, h, pv, n, dr in data],
                                 "domain string, harmonic_rank long, harmonic_val double, pr_rank long, pr_val double, "
                                 "n_hosts long, dr_score int, fetched_at timestamp_ntz")


def test_backlinks_enrichment_and_bundle(spark):
    c = _crawls(spark, [("t.com", "r1", "2026-01-01 00:00:00", 2), ("t.com", "r2", "2026-02-01 00:00:00", 2),
                        ("e.com", "r1", "2026-01-01 00:00:00", 0)])
    b = _links(spark, [("t.com", "r1", "old.org", 1), ("t.com", "r2", "a.org", 10), ("t.com", "r2", "b.org", 0)])
    ranks = _ranks(spark, [("a.org", 5, 0.5, 3, 90), ("t.com", 9, 0.1, 4, 70)])
    maj = spark.createDataFrame([("b.org", 7, 1, 2, 3, None)],
                                "domain string, global_rank long, tld_rank long, ref_subnets long, ref_ips long, fetched_at timestamp_ntz")
    tr = spark.createDataFrame([("a.org", 11, None)], "domain string, tranco_rank long, fetched_at timestamp_ntz")
    rep = backlinks_report(c, b, ranks, maj, tr)
    got = rows(rep, "target", "release", "linking_domain", "dr_score", "pagerank", "authority_score",
               "majestic_rank", "tranco_rank")
    assert got == [("t.com", "r2", "a.org", 90, 0.5, 15, None, 11), ("t.com", "r2", "b.org", None, None, 0, 7, None)]
    head = bundle_report(c, ranks).collect()
    assert [(r.target, r.backlink_count, r.target_dr_score, r.target_n_hosts) for r in head] == [("t.com", 2, 70, 4)]
    nested = nested_report(rep, c, page_size=1).collect()
    assert sum(len(r.backlinks) for r in nested) == 2 and {r.backlink_count for r in nested} == {2}


def test_preview_excludes_after_the_pool_cut(spark):
    # 60 linkers: the top 50 by DR include 48 platform-like names; after exclusion only 2 remain.
    c = _crawls(spark, [("t.com", "r1", "2026-01-01 00:00:00", 60)])
    names = [f"p{i}.blog" for i in range(48)] + ["keep1.org", "keep2.org"] + [f"low{i}.org" for i in range(10)]
    b = _links(spark, [("t.com", "r1", n, 1) for n in names])
    ranks = _ranks(spark, [(n, i + 1, 0.0, 1, 100 - i) for i, n in enumerate(names)])
    out = preview_report(c, b, ranks, exclude=[f"p{i}.blog" for i in range(48)])
    got = rows(out, "domain", "pos", "linking_domain", "showing", "total_backlinks")
    assert got == [("t.com", 1, "keep1.org", 2, 60), ("t.com", 2, "keep2.org", 2, 60)]


def test_preview_default_list_and_empty_target(spark):
    c = _crawls(spark, [("t.com", "r1", "2026-01-01 00:00:00", 2), ("z.com", "r1", "2026-01-01 00:00:00", 0)])
    b = _links(spark, [("t.com", "r1", "blogspot.com", 50), ("t.com", "r1", "real.org", 2)])
    out = preview_report(c, b, _ranks(spark, [("z.com", 1, 0.0, 1, 100)]))
    got = rows(out, "domain", "linking_domain", "showing", "target_dr_score", "authority_score")
    assert got == [("t.com", "real.org", 1, None, 5), ("z.com", None, 0, 100, None)]


def test_gap(spark):
    c = _crawls(spark, [("me.com", "r1", "2026-01-01 00:00:00", 1), ("me.com", "r2", "2026-03-01 00:00:00", 1),
                        ("them.com", "r1", "2026-01-01 00:00:00", 3), ("empty.com", "r1", "2026-01-01 00:00:00", 0)])
    b = _links(spark, [("me.com", "r1", "x.org", 1), ("me.com", "r2", "shared.org", 5),
                       ("them.com", "r1", "shared.org", 5), ("them.com", "r1", "a.org", 0),
                       ("them.com", "r1", "b.org", 3)])
    maj = spark.createDataFrame([("a.org", 7, 1, 2, 3, None)],
                                "domain string, global_rank long, tld_rank long, ref_subnets long, ref_ips long, fetched_at timestamp_ntz")
    tr = spark.createDataFrame([("b.org", 11, None)], "domain string, tranco_rank long, fetched_at timestamp_ntz")
    pairs = spark.createDataFrame([(" ME.com. ", "them.com"), ("me.com", "empty.com"), ("me.com", "never.com")],
                                  "yours string, competitor string")
    g = order_gap(gap(pairs, c, b, maj, tr)).collect()
    assert [(r.domain, r.num_hosts, r.authority_score, r.page_rank, r.majestic_rank, r.tranco_rank) for r in g] == [
        ("b.org", 3, 7, None, None, 11), ("a.org", 0, None, None, 7, None)]
    s = rows(gap_summary(pairs, c, b), "competitor", "your_backlinks", "competitor_backlinks", "gap_count")
    assert s == [("empty.com", 1, 0, 0), ("them.com", 1, 3, 2)]
    assert rows(gap_missing(pairs, c), "competitor", "missing") == [("never.com", "competitor")]


def test_orderings(spark):
    from linkweave.operators.enrich import order_backlinks
    from linkweave.operators.graph import order_inbound
    df = spark.createDataFrame([("t", "b.org", 5, None), ("t", "a.org", 5, None), ("t", "c.org", 1, 40),
                                ("t", "d.org", 9, 40), ("s", "z.org", 1, None)],
                               "target string, linking_domain string, num_hosts long, dr_score int")
    assert [r.linking_domain for r in order_backlinks(df).collect()] == ["z.org", "d.org", "c.org", "a.org", "b.org"]
    assert [r.linking_domain for r in order_inbound(df).collect()] == ["z.org", "d.org", "a.org", "b.org", "c.org"]
    g = spark.createDataFrame([("y", "c", "b.org", None), ("y", "c", "a.org", 0), ("y", "c", "c.org", 2)],
                              "yours string, competitor string, domain string, num_hosts long")
    assert [r.domain for r in order_gap(g).collect()] == ["c.org", "a.org", "b.org"]
