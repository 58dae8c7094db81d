"""Linkers nested into response pages, one row per (target, page).

A page holds ``page_size`` neighbours of the response order (the last one fewer), so no
single row has to hold a whole popular target, and pages one after the other are the
response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGE_SIZE = 10_000


def nest_backlinks(rows: DataFrame, counts: DataFrame, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """rows: target, pos (1, 2, ... in response order), linking_domain, ... ; counts: target, backlink_count.

    -> target, backlink_count, page (from 0), backlinks (array of structs in order).
    """
    page = F.floor((F.col("pos") - 1) / F.lit(page_size)).cast("int")
    entry = F.struct("pos", *[c for c in rows.columns if c not in ("target", "pos")])
    pages = (rows.withColumn("page", page).groupBy("target", "page")
             .agg(F.sort_array(F.collect_list(entry)).alias("backlinks")))
    return pages.join(counts, "target").select("target", "backlink_count", "page", "backlinks")
