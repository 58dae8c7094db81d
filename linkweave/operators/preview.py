"""Preview (W3, P6, O3): per target the top 50 linkers by DR, platforms removed, first 5 shown.

The cut is a `row_number() <= k` filter; Spark plans it with a partial
WindowGroupLimit before the shuffle, so each target contributes at most k rows
per input partition to the exchange however many linkers it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.scores import authority_score
from linkweave.operators.enrich import target_profile
from linkweave.operators.joins import broadcast_if_small

# --- Fixed values (must equal the reference's list) -----------------------------
# Hosting / user-content platforms left out of the preview (exact match).
PREVIEW_EXCLUDE = [
    "blogspot.com", "wordpress.com", "weebly.com", "wixsite.com", "wix.com",
    "webflow.io", "livejournal.com", "github.io", "substack.com", "amazonaws.com",
    "neocities.org", "wpengine.com", "fc2.com", "mystrikingly.com", "gitbook.io",
    "vercel.app", "netlify.app", "herokuapp.com", "medium.com", "tumblr.com",
    "squarespace.com", "godaddysites.com", "hatenablog.com", "over-blog.com",
    "typepad.com", "jimdofree.com", "sites.google.com", "wikidot.com",
    "uptodown.com", "informer.com", "softonic.com", "myshopify.com",
    "free.fr", "cloudfront.net", "seesaa.net", "aptoide.com",
]
PREVIEW_POOL = 50
PREVIEW_SHOW = 5
# -------------------------------------------------------------------------------


def drop_platforms(df: DataFrame, names=None, col: str = "linking_domain",
                   table: DataFrame | None = None) -> DataFrame:
    """Drop rows whose domain is in the exclude list (exact match).

    ``table`` (column `domain`) is an optional exclude table, anti-joined (broadcast when small).
    """
    names = PREVIEW_EXCLUDE if names is None else list(names)
    if names:
        df = df.where(~F.col(col).isin(*names))
    if table is not None:
        ex = broadcast_if_small(table.select(F.col("domain").alias(col)).distinct())
        df = df.join(ex, col, "left_anti")
    return df


def _top(df: DataFrame, k: int, name: str) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.desc_nulls_last("dr_score"), F.desc("num_hosts"),
                                             F.asc("linking_domain"))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def preview(latest: DataFrame, latest_links: DataFrame, ranks: DataFrame, exclude=None,
            pool: int = PREVIEW_POOL, show: int = PREVIEW_SHOW,
            exclude_table: DataFrame | None = None) -> DataFrame:
    """Q4 as flat rows: one row per shown linker, target fields repeated.

    ``latest``: latest crawl per target (target, release, crawled_at, result_count);
    ``latest_links``: its backlinks. A target whose preview is empty keeps one
    row with NULL linker fields and showing = 0.
    """
    linked = latest_links.join(
        ranks.select(F.col("domain").alias("linking_domain"), "dr_score"), "linking_domain", "left")
    pooled = _top(linked.select("target", "linking_domain", "num_hosts", "dr_score"), pool, "_pool_pos")
    shown = _top(drop_platforms(pooled.drop("_pool_pos"), exclude, table=exclude_table), show, "pos")
    showing = shown.groupBy("target").agg(F.count(F.lit(1)).alias("showing"))
    head = target_profile(latest.select("target", F.col("result_count").alias("total_backlinks")), ranks)
    head = (head.join(showing, "target", "left")
            .select(F.col("target").alias("domain"), "target_dr_score", "target_harmonic_rank",
                    "total_backlinks", F.coalesce("showing", F.lit(0)).cast("long").alias("showing")))
    rows = shown.select(F.col("target").alias("domain"), F.col("pos").cast("int").alias("pos"),
                        "linking_domain", "num_hosts", "dr_score",
                        authority_score(F.col("num_hosts")).alias("authority_score"))
    return head.join(rows, "domain", "left")
