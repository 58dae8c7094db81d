"""Rank tables: top-N filter (P4) and the rank ingest (Q8: S3, F9, P4, F6, K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkweave.functions.scores import TOTAL_DOMAINS, derive_dr
from linkweave.functions.timekeys import as_of as as_of_col
from linkweave.functions.util import lit_or_col
from linkweave.operators.dedupe import dedupe_last
from linkweave.sources.text import parse_rank_lines

# --- Fixed values (the reference's default) -------------------------------------
DEFAULT_RANK_LIMIT = 5_000_000
# -------------------------------------------------------------------------------
RANK_COLS = ["domain", "harmonic_rank", "harmonic_val", "pr_rank", "pr_val", "n_hosts", "dr_score", "fetched_at"]


def top_ranks(df: DataFrame, limit=DEFAULT_RANK_LIMIT) -> DataFrame:
    """Rows with harmonic_rank <= limit (a filter, so unsorted input is handled too)."""
    return df.where(F.col("harmonic_rank") <= lit_or_col(limit))


def ranks_from_rows(rows: DataFrame, limit=DEFAULT_RANK_LIMIT, total=TOTAL_DOMAINS, as_of=None) -> DataFrame:
    """P4 -> F6 -> K8 on parsed rank rows: top rows, DR score, one row per domain.

    Last write wins per domain; on a rank-sorted file the last duplicate is the
    one with the largest harmonic_rank, so that row is kept.
    """
    kept = top_ranks(rows, limit).select(
        "domain", "harmonic_rank", "harmonic_val", "pr_rank", "pr_val", "n_hosts",
        derive_dr(F.col("harmonic_rank"), total).alias("dr_score"),
        as_of_col(as_of).alias("fetched_at"))
    return dedupe_last(kept, ["domain"], ["harmonic_rank", "harmonic_val", "pr_rank", "pr_val", "n_hosts"])


def ingest_ranks(lines: DataFrame, limit=DEFAULT_RANK_LIMIT, total=TOTAL_DOMAINS, as_of=None) -> DataFrame:
    """Q8: rank lines (`value`) -> ranks table rows."""
    return ranks_from_rows(parse_rank_lines(lines), limit, total, as_of).select(*RANK_COLS)


def ingest_ranks_observed(lines: DataFrame, limit=DEFAULT_RANK_LIMIT, total=TOTAL_DOMAINS,
                          as_of=None) -> tuple[DataFrame, Observation]:
    """Q8 + A10: the ingest plus an Observation that reports `rows_kept` once the result is written.

    The count rides along with the write job (no second pass over the data).
    """
    obs = Observation("rank_ingest")
    df = ingest_ranks(lines, limit, total, as_of).observe(obs, F.count(F.lit(1)).alias("rows_kept"))
    return df, obs
