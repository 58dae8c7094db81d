"""Crawl store operators: crawl results per (target, release) and their maintenance.

crawls    : target, release, crawled_at, result_count       key (target, release)
backlinks : target, release, linking_domain, num_hosts, page_rank
            key (target, release, linking_domain)

The store is keyed by names, not surrogate ids, so replacing a crawl is an
anti-join plus a union (K6) and never needs a driver-side id counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.domains import valid_domain
from linkweave.functions.timekeys import as_of as as_of_col
from linkweave.operators.graph import DEFAULT_BUCKETS, inbound
from linkweave.operators.joins import DEFAULT_BROADCAST_ROWS, broadcast_if_small
from linkweave.session import materialize

CRAWL_COLS = ["target", "release", "crawled_at", "result_count"]
BACKLINK_COLS = ["target", "release", "linking_domain", "num_hosts", "page_rank"]


def normalise_targets(targets: DataFrame, col: str = "target") -> DataFrame:
    """F1 on a target list: valid, normalised, distinct names (invalid ones drop out)."""
    return (targets.select(valid_domain(F.col(col)).alias("target"))
            .where(F.col("target").isNotNull()).distinct())


def crawl_counts(targets: DataFrame, backlinks: DataFrame, release: str, crawled_at) -> DataFrame:
    """A1: one crawl row per target with its result count; zero-result crawls are kept."""
    counts = backlinks.groupBy("target").agg(F.count(F.lit(1)).alias("result_count"))
    return (targets.join(counts, "target", "left")
            .select("target", F.lit(release).alias("release"), as_of_col(crawled_at).alias("crawled_at"),
                    F.coalesce(F.col("result_count"), F.lit(0)).cast("long").alias("result_count")))


def crawl_and_store(targets: DataFrame, vertices: DataFrame, edges: DataFrame, release: str,
                    as_of=None, n_buckets: int = DEFAULT_BUCKETS,
                    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Q10: crawl every target of ``targets`` on one graph release -> (crawls, backlinks).

    The backlinks are written once to the shared scratch folder and the crawl rows are counted
    from there, so the graph joins run once for both.
    """
    t = normalise_targets(targets)
    links = inbound(edges, vertices, t, n_buckets, max_broadcast_rows)
    backlinks = links.select("target", F.lit(release).alias("release"), "linking_domain",
                             F.col("num_hosts").cast("long").alias("num_hosts"),
                             F.lit(None).cast("double").alias("page_rank"))
    backlinks = materialize(backlinks, "crawled-links")
    return crawl_counts(t, backlinks, release, as_of), backlinks


def latest_crawl(crawls: DataFrame) -> DataFrame:
    """The latest crawl per target (crawled_at, then release, breaks ties).

    An aggregate (max_by) instead of a window: partial aggregation keeps a target
    with many releases from piling into one task.
    """
    order = F.struct("crawled_at", "release", "result_count")
    return (crawls.groupBy("target")
            .agg(F.max_by(F.struct("release", "crawled_at", "result_count"), order).alias("_c"))
            .select("target", "_c.release", "_c.crawled_at", "_c.result_count"))


def backlinks_of(crawls: DataFrame, backlinks: DataFrame) -> DataFrame:
    """Backlinks of the given crawl rows (inner on target, release)."""
    return backlinks.join(crawls.select("target", "release", "crawled_at"), ["target", "release"])


def latest_backlinks(crawls: DataFrame, backlinks: DataFrame) -> DataFrame:
    """W1 + J8: backlinks of each target's latest crawl, with crawled_at.

    W2 (latest row per (target, linking_domain) across crawls) equals this for
    every linker that comes from the latest crawl, which is the only way it is used.
    """
    return backlinks_of(latest_crawl(crawls), backlinks)


def upsert_crawls(crawls: DataFrame, backlinks: DataFrame, new_crawls: DataFrame, new_backlinks: DataFrame,
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Replace every (target, release) present in the new crawls -> (crawls, backlinks)."""
    keys = broadcast_if_small(new_crawls.select("target", "release").distinct(), max_broadcast_rows)
    c = crawls.join(keys, ["target", "release"], "left_anti").select(*CRAWL_COLS)
    b = backlinks.join(keys, ["target", "release"], "left_anti").select(*BACKLINK_COLS)
    return (c.unionByName(new_crawls.select(*CRAWL_COLS)),
            b.unionByName(new_backlinks.select(*BACKLINK_COLS)))


def merge_seed(live_crawls: DataFrame, live_backlinks: DataFrame, seed_crawls: DataFrame,
               seed_backlinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add seed crawls (all their releases) whose target is absent from live, with their backlinks."""
    live_targets = live_crawls.select("target").distinct()
    new_c = seed_crawls.join(live_targets, "target", "left_anti").select(*CRAWL_COLS)
    new_b = seed_backlinks.join(new_c.select("target", "release"), ["target", "release"]).select(*BACKLINK_COLS)
    return (live_crawls.select(*CRAWL_COLS).unionByName(new_c),
            live_backlinks.select(*BACKLINK_COLS).unionByName(new_b))


def list_domains(crawls: DataFrame) -> DataFrame:
    """Every stored crawl, newest first, with the total row count."""
    total = crawls.agg(F.count(F.lit(1))).scalar()
    return (crawls.select(F.col("target").alias("domain"), "release", "crawled_at",
                          F.col("result_count").alias("backlink_count"), total.alias("total"))
            .orderBy(F.desc("crawled_at"), "domain", "release"))
