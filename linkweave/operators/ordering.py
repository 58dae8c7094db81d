"""Response order as data: a `pos` column (1, 2, ... per key in a given order) that stays
correct and balanced when one key holds a large share of all rows.

A `row_number()` window would sort each key's rows in a single task. Instead:

1. range-partition and sort on (key, order) -- a hot key is spread over many
   partitions, each holding a contiguous slice of its order;
2. number rows inside each partition (`monotonically_increasing_id` right after
   the sort) and write the result once (lineage cut, no second sort);
3. count rows per (key, partition) -- at most one row per key and partition --
   and turn the counts into per-partition start offsets with a small window;
4. pos = offset + index within the partition slice + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.operators.joins import broadcast_if_small
from linkweave.session import materialize

_LOW_BITS = (1 << 33) - 1


def with_positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos",
                   partitions: int | None = None) -> DataFrame:
    """``df`` plus ``name``: the 1-based position of each row within its key in ``order``.

    ``order`` must make rows of one key totally ordered (add a unique tie-breaker);
    key columns must not be NULL.
    """
    sort_cols = [F.col(k).asc() for k in keys] + list(order)
    spread = df.repartitionByRange(partitions, *sort_cols) if partitions else df.repartitionByRange(*sort_cols)
    numbered = spread.sortWithinPartitions(*sort_cols).select(
        "*", F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)).alias("_idx"))
    stored = materialize(numbered, "positions")
    slices = stored.groupBy(*keys, "_pid").agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*keys, "_pid", "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = stored.join(broadcast_if_small(offsets), [*keys, "_pid"])
    pos = (F.col("_start") + F.col("_idx") - F.col("_first") + 1).cast("long").alias(name)
    return out.select(*df.columns, pos)
