"""Rank-table enrichment (J4-J7) and the response projection.

The rank tables are keyed by domain and hold up to a few million rows; they
are left joins on `linking_domain`, planned by Catalyst/AQE (broadcast when the
runtime size is below the threshold, shuffle otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.scores import authority_score


def with_ranks(df: DataFrame, ranks: DataFrame, on: str = "linking_domain") -> DataFrame:
    """Adds dr_score, harmonic_rank, pr_val (NULL when the linker is not ranked)."""
    r = ranks.select(F.col("domain").alias(on), "dr_score", "harmonic_rank", "pr_val")
    return df.join(r, on, "left")


def with_majestic(df: DataFrame, majestic: DataFrame, on: str = "linking_domain") -> DataFrame:
    """Adds global_rank, ref_subnets, ref_ips."""
    m = majestic.select(F.col("domain").alias(on), "global_rank", "ref_subnets", "ref_ips")
    return df.join(m, on, "left")


def with_tranco(df: DataFrame, tranco: DataFrame, on: str = "linking_domain") -> DataFrame:
    """Adds tranco_rank."""
    t = tranco.select(F.col("domain").alias(on), "tranco_rank")
    return df.join(t, on, "left")


def target_profile(targets: DataFrame, ranks: DataFrame, on: str = "target") -> DataFrame:
    """The target's own rank row (NULLs when absent)."""
    r = ranks.select(F.col("domain").alias(on),
                     F.col("dr_score").alias("target_dr_score"),
                     F.col("harmonic_rank").alias("target_harmonic_rank"),
                     F.col("pr_val").alias("target_pagerank"),
                     F.col("n_hosts").alias("target_n_hosts"))
    return targets.join(r, on, "left")


def backlink_projection(df: DataFrame) -> DataFrame:
    """the linker fields of the backlinks response."""
    return df.select(
        "target", "release", "crawled_at", "linking_domain", "num_hosts", "dr_score", "harmonic_rank",
        F.col("pr_val").alias("pagerank"),
        authority_score(F.col("num_hosts")).alias("authority_score"),
        F.col("global_rank").alias("majestic_rank"),
        "ref_subnets", "ref_ips", "tranco_rank",
    )


def backlink_order() -> list:
    """Sort order of the response (for `with_positions`)."""
    return [F.desc_nulls_last("dr_score"), F.desc("num_hosts"), F.asc("linking_domain")]


def order_backlinks(df: DataFrame) -> DataFrame:
    """O2: dr_score DESC NULLS LAST, num_hosts DESC, linking_domain (per target)."""
    return df.orderBy("target", F.desc_nulls_last("dr_score"), F.desc("num_hosts"), "linking_domain")
