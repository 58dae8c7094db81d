"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator group of the survey.

Every query reads the driver tables through ``Fixture`` (or data Spark wrote
from them) and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.contacts import confidence_label, confidence_pct, payer_of
from linkweave.functions.domains import invalid_domains, loose_domain, reverse_domain, url_to_domain, valid_domain
from linkweave.functions.scores import authority_or_null, authority_score, derive_dr
from linkweave.functions.timekeys import month_of
from linkweave.operators.crawls import latest_crawl, list_domains, merge_seed, upsert_crawls
from linkweave.operators.contacts import contacts_to_fetch, enrich_contacts, lookup_rows
from linkweave.operators.dedupe import key_violations
from linkweave.operators.enrich import backlink_order
from linkweave.operators.gap import gap, gap_order, gap_missing, gap_summary
from linkweave.operators.graph import bucket_of, bucket_range, inbound, inbound_order
from linkweave.operators.ordering import with_positions
from linkweave.operators.ranks import ingest_ranks
from linkweave.operators.usage import add_to_totals, admit, stored_totals, usage_by_month, usage_by_payer, usage_merge
from linkweave.plans import fixtures as fx
from linkweave.plans.convert import convert_graph
from linkweave.plans.reports import (backlinks_report, bundle_report, bundle_rows, ensure_crawled, nested_report,
                                     preview_report)
from linkweave.session import literal_rows, scratch_path
from linkweave.sinks import parts
from linkweave.sinks.contact_cache import (CACHE_SCHEMA, append_to_cache, enrich_from_cache, fold_cache,
                                           to_fetch_from_cache)
from linkweave.sinks.layout import (publish_rank_tables, read_published_ranks, store_status, write_edges,
                                    write_missing_buckets)
from linkweave.sinks.rank_ingest import ingest_rank_dump, run_log
from linkweave.sinks.store import vacuum_crawl_log, write_crawl_epoch, write_once
from linkweave.sources.responses import match_answers, parse_match_responses
from linkweave.sources.tables import read_graph
from linkweave.sources.text import parse_rank_lines, read_edges, read_rank_lines, read_vertices
from linkweave.streaming.crawls import read_crawl_log, run_crawl_stream
from linkweave.streaming.ranks import fold_rank_log, rank_line_stream, read_rank_log, run_rank_stream
from linkweave.streaming.usage import charged_calls, run_usage_stream, usage_counts

Query = Callable[[SparkSession, str], DataFrame]

# Literal inputs mixed into whole-table inputs to cover edge cases.
URL_LITERALS = [
    (-1, "  HTTPS://Example.COM./path?q=1"),
    (-2, "http://bad_host.com/x"),
    (-3, "ftp://files.example.com/a"),
    (-4, "sub.-dash.com"),
    (-5, "a..b.com"),
    (-6, "example.com:8080/x"),
    (-7, "no-tld"),
]
REVERSE_LITERALS = [(-1, "a..b."), (-2, ""), (-3, "com"), (-4, "uk.co.bbc")]
SCORE_LITERALS = [("zero.example", 0, 0), ("negative.example", -5, -1), ("huge.example", 10 ** 12, 10 ** 15)]
VERTEX_BAD_LINES = ["x\tcom.bad\t1", "1\tcom.short", "", "2\tcom.extra\t3\t4", "3\t\t4", "\tcom.noid\t5",
                    "7\tcom.float\t1.5", " 8 \tcom.space\t 9 ", "1\tcom.tab\t\t5", "\t9\tcom.tab"]
SLICE = (3, 17)  # bucket range of P3
RESUME_BUCKETS = 12
CACHE_N = 32  # buckets of the contact cache
EDGE_BAD_LINES = ["1", "1\t2\t3", "a\t2", "", "4\t", " 5 \t6", "7\t8.0", "1\t\t2", "\t1\t2", "1\t2\t"]


def _fx(spark: SparkSession, sf_dir: str) -> fx.Fixture:
    return fx.Fixture(spark, sf_dir)


# ---- functions --------------------------------------------------------------------------

def q_normalize_domains(spark, sf_dir):
    f = _fx(spark, sf_dir)
    urls = f.table("pages").select("page_id", "url").unionByName(
        literal_rows(spark, URL_LITERALS, "page_id long, url string"))
    host = url_to_domain(F.col("url"))
    return urls.select("page_id", "url", host.alias("host"), valid_domain(host).alias("valid_host"),
                       loose_domain(host).alias("loose_host"))


def q_reverse_domains(spark, sf_dir):
    f = _fx(spark, sf_dir)
    v = f.vertices.select("id", "rev_domain").unionByName(
        literal_rows(spark, REVERSE_LITERALS, "id long, rev_domain string"))
    return v.select("id", "rev_domain", reverse_domain(F.col("rev_domain")).alias("domain"))


def q_scores(spark, sf_dir):
    f = _fx(spark, sf_dir)
    rows = f.rank_rows.select("domain", "harmonic_rank", "n_hosts").unionByName(
        literal_rows(spark, SCORE_LITERALS, "domain string, harmonic_rank long, n_hosts long"))
    return rows.select("domain", "harmonic_rank", "n_hosts",
                       derive_dr(F.col("harmonic_rank"), f.rank_total).alias("dr_score"),
                       authority_score(F.col("n_hosts")).alias("authority_score"),
                       authority_or_null(F.col("n_hosts")).alias("authority_or_null"))


def q_parse_ranks(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return ingest_ranks(read_rank_lines(spark, f.rank_dump), limit=f.rank_total, total=f.rank_total,
                        as_of=fx.RANKS_AT)


def _lines(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
                     .alias("value"))


def _dumps(spark, sf_dir) -> tuple[str, str]:
    """The fixture graph as gzip text dumps (plus malformed lines), written once per session."""
    f = _fx(spark, sf_dir)

    def write(path: str) -> None:
        for name, df, cols, bad in (("vertices", f.vertices, ["id", "rev_domain", "num_hosts"], VERTEX_BAD_LINES),
                                    ("edges", f.edges, ["from_id", "to_id"], EDGE_BAD_LINES)):
            lines = _lines(df, cols).unionByName(literal_rows(spark, [(x,) for x in bad], "value string"))
            lines.write.option("compression", "gzip").text(f"{path}/{name}")

    base = write_once(spark, f.shared_root("dumps"), write)
    return f"{base}/vertices", f"{base}/edges"


def q_scan_vertices_text(spark, sf_dir):
    return read_vertices(spark, _dumps(spark, sf_dir)[0])


def q_scan_edges_text(spark, sf_dir):
    return read_edges(spark, _dumps(spark, sf_dir)[1])


def _converted_store(spark, sf_dir) -> str:
    """Q9 end to end: gzip text dumps -> bucketed Parquet store (written once per session)."""
    vertices_dump, edges_dump = _dumps(spark, sf_dir)
    base = write_once(spark, _fx(spark, sf_dir).shared_root("graph"),
                      lambda path: convert_graph(spark, vertices_dump, edges_dump, f"{path}/store", fx.BUCKETS))
    return f"{base}/store"


def q_bucketed_edges(spark, sf_dir):
    store = _converted_store(spark, sf_dir)
    _, edges = read_graph(spark, store)
    return (edges.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("to_id").alias("n_targets"),
                 F.min("to_id").alias("min_to_id"), F.max("to_id").alias("max_to_id")))


def q_stored_vertices(spark, sf_dir):
    return read_graph(spark, _converted_store(spark, sf_dir))[0].select("id", "rev_domain", "num_hosts")


def q_stored_edges(spark, sf_dir):
    return read_graph(spark, _converted_store(spark, sf_dir))[1].select("bucket", "from_id", "to_id")


def q_bucket_slice(spark, sf_dir):
    """P3 with a range that leaves out most targets at any scale factor."""
    _, edges = read_graph(spark, _converted_store(spark, sf_dir))
    return bucket_range(edges, *SLICE).select("bucket", "from_id", "to_id")


def q_inbound_bucketed(spark, sf_dir):
    """J1-J3 on the converted store: targets and edges through their partition columns."""
    vertices, edges = read_graph(spark, _converted_store(spark, sf_dir))
    t = _fx(spark, sf_dir).targets.select(valid_domain(F.col("target")).alias("target"))  # the invalid one is NULL here
    return with_positions(inbound(edges, vertices, t, fx.BUCKETS), ["target"], inbound_order())


def q_resume_edges(spark, sf_dir):
    """K5: a conversion that stopped -- some buckets complete, one half written, a stale task folder -- and its resume."""
    f = _fx(spark, sf_dir)
    edges = read_edges(spark, _dumps(spark, sf_dir)[1])

    def write(path: str) -> None:
        b = bucket_of("to_id", RESUME_BUCKETS)
        write_edges(edges.where(b < RESUME_BUCKETS // 2), f"{path}/edges", RESUME_BUCKETS)
        half = edges.where((b == RESUME_BUCKETS - 1) & (F.pmod("from_id", F.lit(2)) == 0))
        half.select("from_id", "to_id", b.alias("bucket")).write.mode("append").partitionBy("bucket").parquet(f"{path}/edges")
        spark.range(1).write.parquet(f"{path}/edges/_temporary/0")
        write_missing_buckets(edges, f"{path}/edges", RESUME_BUCKETS)
        write_missing_buckets(edges, f"{path}/edges", RESUME_BUCKETS)  # nothing is left to do

    path = write_once(spark, f.shared_root("resume"), write)
    return spark.read.schema("from_id long, to_id long, bucket int").parquet(f"{path}/edges").select("bucket", "from_id", "to_id")


def q_store_status_checked(spark, sf_dir):
    """The parts of the status that do not depend on the run, of a store and of one that is not there."""
    store = _converted_store(spark, sf_dir)
    out = None
    for name, path in (("here", store), ("nowhere", f"{store}-missing")):
        s = store_status(spark, path, fx.BUCKETS).select(
            F.lit(name).alias("store"), "available", "edge_bucket_count", (F.col("edge_files") >= F.col("edge_bucket_count")).alias("files_ok"),
            (F.col("vertices_parquet_mb") >= 0).alias("has_vertices"), (F.col("edges_total_gb") >= 0).alias("has_edges"),
            (F.col("edges_last_modified_unix") > 0).alias("has_time"))
        out = s if out is None else out.unionByName(s)
    return out


def q_store_status(spark, sf_dir):
    return store_status(spark, _converted_store(spark, sf_dir), fx.BUCKETS)


# ---- graph and reports --------------------------------------------------------------------

def q_inbound(spark, sf_dir):
    f = _fx(spark, sf_dir)
    t = f.targets.select(valid_domain(F.col("target")).alias("target")).where(F.col("target").isNotNull())
    return with_positions(inbound(f.edges, f.vertices, t), ["target"], inbound_order())


def q_inbound_raw(spark, sf_dir):
    """The slow path: inbound linkers straight from the gzip text dumps (no bucketed store)."""
    f = _fx(spark, sf_dir)
    vertices_dump, edges_dump = _dumps(spark, sf_dir)
    t = f.targets.select(valid_domain(F.col("target")).alias("target")).where(F.col("target").isNotNull())
    return inbound(read_edges(spark, edges_dump), read_vertices(spark, vertices_dump), t)


def q_crawl_store(spark, sf_dir):
    return _fx(spark, sf_dir).crawled[0]


def q_backlinks(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return with_positions(backlinks_report(f.crawls, f.backlinks, f.ranks, f.majestic, f.tranco), ["target"],
                          backlink_order())


def q_backlinks_on_demand(spark, sf_dir):
    """Q1 with its whole lifecycle: targets without a stored crawl are crawled first (Q10/K6)."""
    f = _fx(spark, sf_dir)
    rel2 = lambda df: df.where(F.col("release") == fx.REL2)
    crawls, backlinks = ensure_crawled(f.targets, rel2(f.crawls), rel2(f.backlinks), f.vertices, f.edges,
                                       fx.REL3, fx.STREAM_AT)
    return backlinks_report(crawls, backlinks, f.ranks, f.majestic, f.tranco)


def q_bundle(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return bundle_report(f.crawls, f.ranks)


def q_bundle_rows(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return bundle_rows(f.crawls, f.backlinks, f.ranks, f.majestic, f.tranco)


def q_backlinks_nested(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return nested_report(backlinks_report(f.crawls, f.backlinks, f.ranks, f.majestic, f.tranco), f.crawls, page_size=200)


def q_backlinks_nested_flat(spark, sf_dir):
    """A9 unnested again: every entry with its page and its place in the page."""
    nested = q_backlinks_nested(spark, sf_dir)
    return nested.select("target", "backlink_count", "page", F.posexplode("backlinks").alias("slot", "b")).select(
        "target", "backlink_count", "page", "slot", "b.pos", "b.linking_domain", "b.num_hosts", "b.dr_score", "b.tranco_rank")


def q_preview(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return preview_report(f.crawls, f.backlinks, f.ranks, extra_exclude=f.preview_exclude)


def q_gap(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return with_positions(gap(f.pairs, f.crawls, f.backlinks, f.majestic, f.tranco), ["yours", "competitor"],
                          gap_order())


def q_gap_summary(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return gap_summary(f.pairs, f.crawls, f.backlinks)


def q_gap_missing(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return gap_missing(f.pairs, f.crawls)


def q_latest_crawl(spark, sf_dir):
    return latest_crawl(_fx(spark, sf_dir).crawls)


def q_list_domains(spark, sf_dir):
    return list_domains(_fx(spark, sf_dir).crawls)


def _upserted(spark, sf_dir):
    f = _fx(spark, sf_dir)
    new_c, new_b = f.recrawl
    return upsert_crawls(f.crawls, f.backlinks, new_c, new_b)


def q_upsert_crawls(spark, sf_dir):
    return _upserted(spark, sf_dir)[0]


def q_upsert_backlinks(spark, sf_dir):
    return _upserted(spark, sf_dir)[1]


def _seeded(spark, sf_dir):
    f = _fx(spark, sf_dir)
    rel = lambda df, r: df.where(F.col("release") == r)
    return merge_seed(rel(f.crawls, fx.REL2), rel(f.backlinks, fx.REL2),
                      rel(f.crawls, fx.REL1), rel(f.backlinks, fx.REL1))


def q_merge_seed(spark, sf_dir):
    return _seeded(spark, sf_dir)[0]


def q_merge_seed_backlinks(spark, sf_dir):
    return _seeded(spark, sf_dir)[1]


def q_key_violations(spark, sf_dir):
    f = _fx(spark, sf_dir)
    crawls_in = f.crawls.unionByName(f.recrawl[0])
    checks = [
        ("crawls", key_violations(crawls_in, ["target", "release"])
         .select(F.concat_ws("|", "target", "release").alias("key"), "n_rows")),
        ("backlinks", key_violations(f.backlinks.unionByName(f.recrawl[1]), ["target", "release", "linking_domain"])
         .select(F.concat_ws("|", "target", "release", "linking_domain").alias("key"), "n_rows")),
        ("rank_lines", key_violations(parse_rank_lines(read_rank_lines(spark, f.rank_dump)), ["domain"])
         .select(F.col("domain").alias("key"), "n_rows")),
    ]
    out = None
    for name, df in checks:
        df = df.select(F.lit(name).alias("table_name"), "key", "n_rows")
        out = df if out is None else out.unionByName(df)
    return out


# ---- contacts and usage ---------------------------------------------------------------------

def q_enrich_contacts(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return enrich_contacts(f.contacts, f.lookups)


def q_contacts_to_fetch(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return contacts_to_fetch(f.contacts, f.lookups)


def _contact_cache(spark, sf_dir) -> str:
    """The lookups arrive in five batches, one of them twice; some are merged, the last is not."""
    f = _fx(spark, sf_dir)

    def write(path: str) -> None:
        batch = F.pmod(F.xxhash64("email", "last_name", "created_at"), F.lit(5))
        for epoch in (0, 1, 0, 2, 3, 4):
            append_to_cache(f.lookups.where(batch == epoch), path, epoch, CACHE_N)

    return write_once(spark, f.shared_root("contact-cache"), write)


def q_contact_cache(spark, sf_dir):
    """J11 and W5 against the keyed cache."""
    return enrich_from_cache(_fx(spark, sf_dir).contacts, _contact_cache(spark, sf_dir), CACHE_N)


def q_contact_cache_to_fetch(spark, sf_dir):
    """J12 against the keyed cache."""
    return to_fetch_from_cache(_fx(spark, sf_dir).contacts, _contact_cache(spark, sf_dir), CACHE_N)


def q_contact_cache_folded(spark, sf_dir):
    """The cache after everything has been folded: one row per contact key."""
    root = scratch_path(spark, "contact-cache-folded")
    lookups = _fx(spark, sf_dir).lookups
    for epoch, part in enumerate((lookups.where("email = ''"), lookups.where("email <> ''"))):
        append_to_cache(part, root, epoch, CACHE_N)
    fold_cache(spark, root)
    return parts.read(spark, root, "lookups", CACHE_SCHEMA, parts.current(spark, root).parts).drop("bucket")


def q_match_responses(spark, sf_dir):
    parsed = parse_match_responses(_fx(spark, sf_dir).match_responses)
    return parsed.drop("body")


def q_match_answers(spark, sf_dir):
    """The answer of a fresh lookup."""
    return match_answers(parse_match_responses(_fx(spark, sf_dir).match_responses))


def q_list_domains_ordered(spark, sf_dir):
    """O5 as data: the place of every stored crawl in the list."""
    order = [F.desc("crawled_at"), F.asc("domain"), F.asc("release")]
    whole = list_domains(_fx(spark, sf_dir).crawls).withColumn("list", F.lit("all"))
    return with_positions(whole, ["list"], order).drop("list")


def q_rejected_targets(spark, sf_dir):
    """Names that validation refuses, among urls of the pages and the crawl targets."""
    f = _fx(spark, sf_dir)
    return invalid_domains(f.targets.unionByName(f.table("pages").select(F.col("url").alias("target"))))


def q_lookup_rows(spark, sf_dir):
    parsed = parse_match_responses(_fx(spark, sf_dir).match_responses)
    return lookup_rows(parsed, created_at=fx.LOOKUP_BASE)


def q_confidence_labels(spark, sf_dir):
    c = _fx(spark, sf_dir).table("customer")
    score = (F.col("c_acctbal") / 10000.0).cast("string")
    return c.select("c_custkey", confidence_label(score).alias("label"), confidence_pct(score).alias("pct"))


def q_payer_of(spark, sf_dir):
    b = _fx(spark, sf_dir).payment_bodies
    return b.select("o_orderkey", payer_of(F.col("body")).alias("payer"))


def q_usage_by_month(spark, sf_dir):
    return usage_by_month(_fx(spark, sf_dir).usage_log)


def q_usage_by_payer(spark, sf_dir):
    return usage_by_payer(_fx(spark, sf_dir).usage_log)


def q_usage_merge(spark, sf_dir):
    log = _fx(spark, sf_dir).usage_log
    totals = usage_by_month(log.where(F.col("o_orderstatus") == "F"))
    increments = usage_by_month(log.where(F.col("o_orderstatus") == "O"))
    return usage_merge(totals, increments, ["month"])


def q_usage_totals(spark, sf_dir):
    """Stored totals over epochs that arrive out of order, one of them three times, before and after a merge."""
    f = _fx(spark, sf_dir)
    root = scratch_path(spark, "usage-totals")
    log = f.usage_log
    for epoch in (0, 1, 1, 4, 3, 5, 1, 2):
        part = log.where(F.pmod("event_id", F.lit(6)) == epoch)
        counts = part.where(F.col("charged")).groupBy(month_of(F.col("ts")).alias("month"), "payer").agg(F.count(F.lit(1)).alias("usage_count"))
        add_to_totals(counts, root, epoch)
    return stored_totals(spark, root)


def q_admit(spark, sf_dir):
    return admit(_fx(spark, sf_dir).usage_log, monthly=fx.ADMIT_MONTHLY, per_payer=fx.ADMIT_PER_PAYER)


# ---- streaming --------------------------------------------------------------------------------

def q_stream_usage(spark, sf_dir):
    f = _fx(spark, sf_dir)
    schema = f.table("events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f.sf_dir)
    log = events.select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("payer"),
                        (F.col("event_type") == "purchase").alias("charged"))
    base = scratch_path(spark, "stream-usage")
    run_usage_stream(charged_calls(log), f"{base}/out", f"{base}/checkpoint")
    return usage_counts(spark, f"{base}/out")


def q_stream_usage_batches(spark, sf_dir):
    """ST1 over three arrivals on one checkpoint: a third of the calls, then repeats with another third (as late
    as the first ones), then everything again."""
    f = _fx(spark, sf_dir)
    base = scratch_path(spark, "stream-usage-batches")
    events = f.table("events").select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("payer"),
                                      (F.col("event_type") == "purchase").alias("charged"))
    third = F.pmod("event_id", F.lit(3))
    for i, part in enumerate((third == 2, (third == 0) | (third == 2), F.lit(True))):
        events.where(part).write.parquet(f"{base}/arrivals/batch={i}")
        feed = (spark.readStream.schema(events.schema).option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.parquet").parquet(f"{base}/arrivals"))
        run_usage_stream(charged_calls(feed), f"{base}/out", f"{base}/checkpoint")
    return usage_counts(spark, f"{base}/out")


def _crawl_epochs(spark, sf_dir) -> str:
    """ST2/K6: ten epochs of the crawl log. Five parts of the targets on the early graph, four of them again on the
    whole one, the first a third time on the early one; full levels are merged, replaced parts removed."""
    f = _fx(spark, sf_dir)

    def write(path: str) -> None:
        for epoch in range(10):
            part = F.pmod("s_suppkey", F.lit(5)) == (0 if epoch == 9 else epoch % 5)
            write_crawl_epoch(path, epoch, [dict(targets=f.supplier_targets(part), vertices=f.vertices,
                                                 edges=f.edges if 5 <= epoch < 9 else f.early_edges, release=fx.REL3, as_of=fx.STREAM_AT)])
        vacuum_crawl_log(spark, path, keep_seconds=0)

    return write_once(spark, f.shared_root("crawl-epochs"), write)


def q_crawl_epochs(spark, sf_dir):
    return read_crawl_log(spark, _crawl_epochs(spark, sf_dir))[0]


def q_crawl_epochs_backlinks(spark, sf_dir):
    return read_crawl_log(spark, _crawl_epochs(spark, sf_dir))[1]


def q_ranks_replaced(spark, sf_dir):
    """K7: a reader that started before a replacement and one that started after it."""
    f = _fx(spark, sf_dir)
    root = scratch_path(spark, "ranks-replaced")
    publish_rank_tables(root, {"ranks": f.ranks_computed})
    before = read_published_ranks(spark, root)[0]
    publish_rank_tables(root, {"ranks": before.where("n_hosts > 10").withColumn("dr_score", F.col("dr_score") + 1), "tranco": f.tranco_computed})
    ranks, _, tranco = read_published_ranks(spark, root)
    out = before.select(F.lit("before").alias("seen"), "domain", "dr_score")
    return (out.unionByName(ranks.select(F.lit("after").alias("seen"), "domain", "dr_score"))
            .unionByName(tranco.select(F.lit("tranco").alias("seen"), "domain", F.col("tranco_rank").cast("int").alias("dr_score"))))


def q_ingest_summary(spark, sf_dir):
    """A10: the run log of two ingests of the rank dump, the second with a lower limit."""
    f = _fx(spark, sf_dir)
    root = scratch_path(spark, "rank-ingest")
    for limit in (f.rank_total, 100):
        ingest_rank_dump(read_rank_lines(spark, f.rank_dump), root, limit=limit, total=f.rank_total, as_of=fx.RANKS_AT)
    return run_log(spark, root)


def q_stream_crawls(spark, sf_dir):
    f = _fx(spark, sf_dir)
    base = scratch_path(spark, "stream-crawls")
    feed = spark.readStream.schema(f.table("supplier").schema).option("pathGlobFilter", "supplier.parquet") \
        .parquet(f.sf_dir)
    targets = feed.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com"))
                          .alias("target"))
    run_crawl_stream(targets, f.vertices, f.edges, f"{base}/log", fx.REL3, fx.STREAM_AT, f"{base}/checkpoint")
    return read_crawl_log(spark, f"{base}/log")[0]


def q_stream_crawls_backlinks(spark, sf_dir):
    """ST2: the backlinks that the crawl feed stored."""
    f = _fx(spark, sf_dir)
    base = scratch_path(spark, "stream-crawls-backlinks")
    feed = spark.readStream.schema(f.table("supplier").schema).option("pathGlobFilter", "supplier.parquet").parquet(f.sf_dir)
    targets = feed.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("target"))
    run_crawl_stream(targets, f.vertices, f.edges, f"{base}/log", fx.REL3, fx.STREAM_AT, f"{base}/checkpoint")
    return read_crawl_log(spark, f"{base}/log")[1]


def q_stream_ranks(spark, sf_dir):
    f = _fx(spark, sf_dir)
    base = scratch_path(spark, "stream-ranks")
    total = lambda s: _fx(s, sf_dir).rank_total
    # The dump folder doubles as the landing folder: every file in it is a new arrival.
    run_rank_stream(rank_line_stream(spark, f.rank_dump), f"{base}/log", f"{base}/checkpoint",
                    limit=total, total=total, as_of=fx.RANKS_AT)
    return read_rank_log(spark, f"{base}/log")


def q_stream_ranks_batches(spark, sf_dir):
    """ST3 over two arrivals: part of the domains come again with a better or a worse rank, which replaces the first."""
    f = _fx(spark, sf_dir)
    base = scratch_path(spark, "stream-ranks-batches")
    total = lambda s: _fx(s, sf_dir).rank_total
    again = f.rank_rows.where(F.col("pr_rank") % 3 == 0).withColumn(
        "harmonic_rank", F.when(F.col("pr_rank") % 2 == 0, F.lit(1)).otherwise(F.col("harmonic_rank") + 1))
    for i, rows in enumerate((f.rank_rows, again)):
        line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("harmonic_rank", "harmonic_val", "pr_rank", "pr_val")],
                           reverse_domain(F.col("domain")), F.col("n_hosts").cast("string"))
        rows.select(line.alias("value")).write.text(f"{base}/landing/batch={i}")
        feed = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true").text(f"{base}/landing")
        run_rank_stream(feed, f"{base}/log", f"{base}/checkpoint", limit=total, total=total, as_of=fx.RANKS_AT)
    fold_rank_log(spark, f"{base}/log")
    return read_rank_log(spark, f"{base}/log")


QUERIES: dict[str, Query] = {
    "normalize_domains": q_normalize_domains,
    "reverse_domains": q_reverse_domains,
    "scores": q_scores,
    "parse_ranks": q_parse_ranks,
    "scan_vertices_text": q_scan_vertices_text,
    "scan_edges_text": q_scan_edges_text,
    "bucketed_edges": q_bucketed_edges,
    "stored_vertices": q_stored_vertices,
    "stored_edges": q_stored_edges,
    "bucket_slice": q_bucket_slice,
    "inbound_bucketed": q_inbound_bucketed,
    "resume_edges": q_resume_edges,
    "store_status_checked": q_store_status_checked,
    "store_status": q_store_status,
    "inbound": q_inbound,
    "inbound_raw": q_inbound_raw,
    "crawl_store": q_crawl_store,
    "backlinks": q_backlinks,
    "backlinks_on_demand": q_backlinks_on_demand,
    "bundle": q_bundle,
    "bundle_rows": q_bundle_rows,
    "backlinks_nested": q_backlinks_nested,
    "backlinks_nested_flat": q_backlinks_nested_flat,
    "preview": q_preview,
    "gap": q_gap,
    "gap_summary": q_gap_summary,
    "gap_missing": q_gap_missing,
    "latest_crawl": q_latest_crawl,
    "list_domains": q_list_domains,
    "upsert_crawls": q_upsert_crawls,
    "upsert_backlinks": q_upsert_backlinks,
    "merge_seed": q_merge_seed,
    "merge_seed_backlinks": q_merge_seed_backlinks,
    "key_violations": q_key_violations,
    "enrich_contacts": q_enrich_contacts,
    "contacts_to_fetch": q_contacts_to_fetch,
    "contact_cache": q_contact_cache,
    "contact_cache_to_fetch": q_contact_cache_to_fetch,
    "contact_cache_folded": q_contact_cache_folded,
    "match_responses": q_match_responses,
    "match_answers": q_match_answers,
    "list_domains_ordered": q_list_domains_ordered,
    "rejected_targets": q_rejected_targets,
    "lookup_rows": q_lookup_rows,
    "confidence_labels": q_confidence_labels,
    "payer_of": q_payer_of,
    "usage_by_month": q_usage_by_month,
    "usage_by_payer": q_usage_by_payer,
    "usage_merge": q_usage_merge,
    "usage_totals": q_usage_totals,
    "admit": q_admit,
    "stream_usage": q_stream_usage,
    "stream_usage_batches": q_stream_usage_batches,
    "stream_ranks_batches": q_stream_ranks_batches,
    "crawl_epochs": q_crawl_epochs,
    "crawl_epochs_backlinks": q_crawl_epochs_backlinks,
    "ranks_replaced": q_ranks_replaced,
    "ingest_summary": q_ingest_summary,
    "stream_crawls": q_stream_crawls,
    "stream_crawls_backlinks": q_stream_crawls_backlinks,
    "stream_ranks": q_stream_ranks,
}
