"""Keyed de-duplication (K8, W5) and key checks.

Both use aggregates (max_by/min_by over a struct) rather than a window, so a hot
key is reduced map-side before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], fn) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    picked = (df.groupBy(*keys)
              .agg(fn(F.struct(*[F.col(c) for c in rest]), ordering).alias("_row")))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """K8: one row per key, the one with the largest `order` (remaining columns break ties)."""
    return _pick(df, keys, order, F.max_by)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W5 style: one row per key, the one with the smallest `order`."""
    return _pick(df, keys, order, F.min_by)


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
