"""Usage metering (Q7: F15, F18, A4, A5, A6, W4, P10).

A usage log holds one row per call: event_id, ts, payer (NULL when unknown),
charged (true for calls that count against the quota).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.timekeys import month_of
from linkweave.operators.ordering import with_positions
from linkweave.sinks import parts

# --- Fixed values (the reference's default limits) ------------------------------
MONTHLY_LIMIT = 500
PER_PAYER_MONTHLY_LIMIT = 100
# -------------------------------------------------------------------------------
TOTAL_SCHEMA = "month string, payer string, usage_count long"


def _charged(log: DataFrame) -> DataFrame:
    return log.where(F.col("charged")).select("event_id", "ts", "payer", month_of(F.col("ts")).alias("month"))


def usage_by_month(log: DataFrame) -> DataFrame:
    """A4: charged calls per month."""
    return _charged(log).groupBy("month").agg(F.count(F.lit(1)).alias("usage_count"))


def usage_by_payer(log: DataFrame) -> DataFrame:
    """A5: charged calls per (month, payer); calls without a payer are not counted here."""
    return (_charged(log).where(F.col("payer").isNotNull())
            .groupBy("month", "payer").agg(F.count(F.lit(1)).alias("usage_count")))


def usage_merge(totals: DataFrame, increments: DataFrame, keys: list[str]) -> DataFrame:
    """Stored totals plus new increments, per key."""
    cols = [*keys, "usage_count"]
    return (totals.select(*cols).unionByName(increments.select(*cols))
            .groupBy(*keys).agg(F.sum("usage_count").cast("long").alias("usage_count")))


def stored_totals(spark: SparkSession, root: str) -> DataFrame:
    """(month, payer, usage_count) of the totals table under ``root``."""
    totals = parts.read(spark, root, "totals", TOTAL_SCHEMA, parts.current(spark, root).parts)
    return totals.groupBy("month", "payer").agg(F.sum("usage_count").cast("long").alias("usage_count"))


def add_to_totals(increments: DataFrame, root: str, epoch: int) -> bool:
    """A6 with exactly-once merging: add the counts (month, payer, usage_count) of epoch ``epoch`` to the stored totals.

    The table knows the epochs that its totals contain, also after parts have been summed up, so an epoch that comes again
    (False) adds nothing and a late one is added once.
    """
    spark = increments.sparkSession

    def write(name: str, _: parts.Manifest) -> None:
        usage_merge(increments, increments.limit(0), ["month", "payer"]).write.parquet(parts.folder(root, "totals", name))

    def summed(old: list[parts.Part], name: str) -> None:
        rows = parts.read(spark, root, "totals", TOTAL_SCHEMA, old)
        usage_merge(rows, rows.limit(0), ["month", "payer"]).write.parquet(parts.folder(root, "totals", name))

    added = parts.add(spark, root, epoch, write)
    parts.merge(spark, root, summed)
    return added


def admit(log: DataFrame, monthly: int = MONTHLY_LIMIT, per_payer: int = PER_PAYER_MONTHLY_LIMIT) -> DataFrame:
    """The charged calls a sequential counter would admit, in (ts, event_id) order.

    A call is refused when its month already has `monthly` admitted calls or its
    payer already has `per_payer` in that month; refused calls count nothing.
    That equals: per (month, payer) keep the first `per_payer` calls (calls without
    a payer all pass), then per month keep the first `monthly` survivors. Both ranks
    come from ``with_positions`` (a range-partitioned sort and per-partition
    offsets), so no month or payer is ranked in one task, whatever the limits.
    Calls without a time belong to no month and are not admitted.
    """
    c = _charged(log).where(F.col("month").isNotNull())
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    paid = with_positions(c.where(F.col("payer").isNotNull()), ["month", "payer"], order, "payer_pos")
    survivors = (paid.where(F.col("payer_pos") <= per_payer).drop("payer_pos")
                 .unionByName(c.where(F.col("payer").isNull())))
    return (with_positions(survivors, ["month"], order, "month_pos").where(F.col("month_pos") <= monthly)
            .select("event_id", "ts", "month", "payer", F.col("month_pos").cast("int").alias("month_pos")))
