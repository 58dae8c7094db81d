"""Composite reports over a crawl store (Q1-Q5), answered for every target at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.crawls import (crawl_and_store, latest_backlinks, latest_crawl,
                                        normalise_targets, upsert_crawls)
from linkweave.operators.enrich import (backlink_order, backlink_projection, target_profile, with_majestic, with_ranks,
                                        with_tranco)
from linkweave.operators.graph import DEFAULT_BUCKETS
from linkweave.operators.joins import broadcast_if_small
from linkweave.operators.nest import DEFAULT_PAGE_SIZE, nest_backlinks
from linkweave.operators.ordering import with_positions
from linkweave.operators.preview import PREVIEW_EXCLUDE, preview


def ensure_crawled(targets: DataFrame, crawls: DataFrame, backlinks: DataFrame, vertices: DataFrame,
                   edges: DataFrame, release: str, as_of=None,
                   n_buckets: int = DEFAULT_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Crawl-if-missing: targets without any stored crawl are crawled and added to the store."""
    t = normalise_targets(targets)
    missing = t.join(crawls.select("target").distinct(), "target", "left_anti")
    new_c, new_b = crawl_and_store(missing, vertices, edges, release, as_of, n_buckets)
    return upsert_crawls(crawls, backlinks, new_c, new_b)


def backlinks_report(crawls: DataFrame, backlinks: DataFrame, ranks: DataFrame, majestic: DataFrame,
                     tranco: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Q1: every linker of each target's latest crawl with DR, PageRank, Majestic, Tranco, authority.

    ``targets`` (optional, column `target`, already normalised) restricts the report.
    """
    latest = latest_crawl(crawls)
    if targets is not None:
        latest = latest.join(broadcast_if_small(targets.select("target").distinct()), "target")
    rows = latest_backlinks(latest, backlinks)
    return backlink_projection(with_tranco(with_majestic(with_ranks(rows, ranks), majestic), tranco))


def bundle_report(crawls: DataFrame, ranks: DataFrame) -> DataFrame:
    """Q2 header: per target with a non-empty latest crawl, its size and the target's own rank profile.

    The linker rows of the bundle are those of Q1.
    """
    latest = latest_crawl(crawls).where(F.col("result_count") > 0)
    head = latest.select("target", "release", "crawled_at", F.col("result_count").alias("backlink_count"))
    return target_profile(head, ranks)


def bundle_rows(crawls: DataFrame, backlinks: DataFrame, ranks: DataFrame, majestic: DataFrame,
                tranco: DataFrame) -> DataFrame:
    """Q2 in full: every linker row of Q1 with the target's own profile beside it."""
    return target_profile(backlinks_report(crawls, backlinks, ranks, majestic, tranco), ranks)


def nested_report(report: DataFrame, crawls: DataFrame, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Q1 rows nested into bounded pages per target; the total is the crawl's stored count."""
    rows = with_positions(report.drop("release", "crawled_at"), ["target"], backlink_order())
    counts = latest_crawl(crawls).select("target", F.col("result_count").alias("backlink_count"))
    return nest_backlinks(rows, counts, page_size)


def preview_report(crawls: DataFrame, backlinks: DataFrame, ranks: DataFrame, exclude=None,
                   extra_exclude: DataFrame | None = None) -> DataFrame:
    """Q4: per target the preview rows (see ``operators.preview.preview``).

    ``extra_exclude`` (column `domain`) adds an exclude table to the list; like the
    list it is applied after the 50-row pool is cut.
    """
    latest = latest_crawl(crawls)
    links = latest_backlinks(latest, backlinks)
    return preview(latest, links, ranks, PREVIEW_EXCLUDE if exclude is None else exclude,
                   exclude_table=extra_exclude)
