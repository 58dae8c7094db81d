"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row bound under which a user-supplied side (targets, pairs, keys) is broadcast.
DEFAULT_BROADCAST_ROWS = 200_000
# Rows that one task sorts or groups: the number of tasks grows with the rows, a task's memory does not.
ROWS_PER_TASK = 500_000


def is_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    """True when ``df`` is proven to have at most ``max_rows`` rows.

    The proof is a count of at most ``max_rows + 1`` rows, so it stays cheap on a large
    input. The planner's size estimate is no proof: it knows nothing of what a
    generator or a well-compressed file expands to.
    """
    return max_rows > 0 and df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it is proven small, else return it unchanged.

    Beyond the bound the join stays a shuffle join (AQE may still pick a
    broadcast from runtime statistics).
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def broadcast_when(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows, ``ROWS_PER_TASK`` each at most, and no fewer than there are cores.

    Spark's own number is a constant of the session, so that its partitions grow with the input.
    """
    return max(math.ceil(rows / ROWS_PER_TASK), spark.sparkContext.defaultParallelism)
