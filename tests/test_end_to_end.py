"""The README flow end to end: dumps -> converted graph -> rank ingest -> crawl store -> reports."""
import gzip

from pyspark.sql import functions as F

from linkweave.operators.gap import gap
from linkweave.operators.ranks import ingest_ranks
from linkweave.plans.convert import convert_graph
from linkweave.plans.reports import backlinks_report, preview_report
from linkweave.sinks.layout import write_ranks
from linkweave.sinks.store import read_latest, write_crawl_runs
from linkweave.sources.tables import read_graph, read_rank_tables
from linkweave.sources.text import read_rank_lines


def test_readme_flow(spark, tmp_dir):
    with gzip.open(f"{tmp_dir}/v.txt.gz", "wt") as fh:
        for i, name in enumerate(["com.me", "com.them", "org.a", "org.b", "net.c"]):
            fh.write(f"{i}\t{name}\t{(i + 1) * 10}\n")
    with gzip.open(f"{tmp_dir}/e.txt.gz", "wt") as fh:
        fh.write("2\t0\n3\t1\n4\t1\n2\t1\nbad\n")
    with gzip.open(f"{tmp_dir}/ranks.txt.gz", "wt") as fh:
        fh.write("#h\n1\t9.0\t1\t0.9\torg.a\t30\n2\t8.0\t2\t0.8\tnet.c\t50\n")
    convert_graph(spark, f"{tmp_dir}/v.txt.gz", f"{tmp_dir}/e.txt.gz", f"{tmp_dir}/graph", n_buckets=8)
    vertices, edges = read_graph(spark, f"{tmp_dir}/graph")
    write_ranks(ingest_ranks(read_rank_lines(spark, f"{tmp_dir}/ranks.txt.gz"), limit=10, total=100),
                f"{tmp_dir}/ranks/ranks")
    spark.createDataFrame([], "domain string, global_rank long, tld_rank long, ref_subnets long, ref_ips long, "
                              "fetched_at timestamp_ntz").write.parquet(f"{tmp_dir}/ranks/majestic")
    spark.createDataFrame([], "domain string, tranco_rank long, fetched_at timestamp_ntz") \
        .write.parquet(f"{tmp_dir}/ranks/tranco")
    ranks, majestic, tranco = read_rank_tables(spark, f"{tmp_dir}/ranks")
    targets = spark.createDataFrame([("ME.com.",), ("them.com",)], "target string")
    store = f"{tmp_dir}/store"
    write_crawl_runs(store, [dict(targets=targets, vertices=vertices, edges=edges, release="r1",
                                  as_of="2026-06-01 00:00:00")], existing=read_latest(spark, store), n_buckets=8)
    crawls, backlinks = read_latest(spark, store)
    report = {(r.target, r.linking_domain): (r.dr_score, r.authority_score)
              for r in backlinks_report(crawls, backlinks, ranks, majestic, tranco).collect()}
    # hosts 30/40/50 -> authority round(15*log10 n) = 22/24/25; rank 2 of 100 -> DR 85
    assert report == {("me.com", "a.org"): (100, 22), ("them.com", "a.org"): (100, 22),
                      ("them.com", "b.org"): (None, 24), ("them.com", "c.net"): (85, 25)}
    prev = preview_report(crawls, backlinks, ranks).where("domain = 'them.com'").orderBy("pos").collect()
    assert [r.linking_domain for r in prev] == ["a.org", "c.net", "b.org"]
    pairs = spark.createDataFrame([("me.com", "them.com")], "yours string, competitor string")
    assert sorted(r.domain for r in gap(pairs, crawls, backlinks, majestic, tranco).collect()) == ["b.org", "c.net"]
    # A second run for a new release appends a version; the latest one is read.
    write_crawl_runs(store, [dict(targets=targets.limit(1), vertices=vertices, edges=edges, release="r2",
                                  as_of="2026-07-01 00:00:00")], existing=read_latest(spark, store), n_buckets=8)
    crawls2, _ = read_latest(spark, store)
    assert crawls2.where(F.col("release") == "r2").count() == 1 and crawls2.count() == 3
