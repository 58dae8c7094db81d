"""ST1: running usage counters per (month, payer) with Structured Streaming.

Every charged call counts once, however late it arrives. A micro-batch is reduced to one row per
event_id; ids that the call log holds already are taken out by an anti-join with the months of the
batch only: the log is partitioned by month, an event keeps its time, and the batch's distinct months (a
bounded list, see ``MAX_MONTHS``) are literals in the scan's partition filter. The new calls and their
counts are one part of the log (``sinks.parts``), so calls and stored totals (A6) change together, a
replayed batch changes nothing, and parts are merged in levels. The counters are read from the stored
totals, never from the calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.timekeys import month_of
from linkweave.operators.usage import TOTAL_SCHEMA, stored_totals, usage_merge
from linkweave.sinks import parts

CALL_SCHEMA = "event_id long, payer string, month string"
# Beyond so many months in one batch the log is read without a month filter.
MAX_MONTHS = 600


def charged_calls(events: DataFrame) -> DataFrame:
    """Streaming (or batch) usage log -> (event_id, payer, month) of the charged calls."""
    return events.where(F.col("charged")).select("event_id", "payer", month_of(F.col("ts")).alias("month"))


def run_usage_stream(calls: DataFrame, out: str, checkpoint: str) -> None:
    """Append new ``charged_calls`` to the call log under ``out`` until the source is drained (availableNow)."""
    out = out.rstrip("/")
    q = (calls.writeStream.foreachBatch(lambda batch, epoch: add_calls(batch, out, epoch))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def add_calls(batch: DataFrame, out: str, epoch: int) -> bool:
    """Store the calls of ``batch`` that the log does not hold yet, and their counts, as epoch ``epoch``; False if it is there."""
    spark = batch.sparkSession

    def write(name: str, manifest: parts.Manifest) -> None:
        rows = batch.groupBy("month", "event_id").agg(F.min("payer").alias("payer")).persist()
        try:
            known = known_calls(spark, out, manifest, months_of(rows)).select(F.col("month").alias("m"), F.col("event_id").alias("e"))
            fresh = rows.join(known, F.col("month").eqNullSafe(F.col("m")) & F.col("event_id").eqNullSafe(F.col("e")), "left_anti")
            calls = parts.folder(out, "calls", name)
            fresh.select("event_id", "payer", "month").hint("rebalance", "month").write.partitionBy("month").parquet(calls)
        finally:
            rows.unpersist()
        new = parts.read(spark, out, "calls", CALL_SCHEMA, [parts.Part(name)])
        new.groupBy("month", "payer").agg(F.count(F.lit(1)).alias("usage_count")).write.parquet(parts.folder(out, "totals", name))

    added = parts.add(spark, out, epoch, write)
    parts.merge(spark, out, lambda old, name: _merge(spark, out, old, name))
    return added


def _merge(spark: SparkSession, out: str, old: list[parts.Part], name: str) -> None:
    calls = parts.read(spark, out, "calls", CALL_SCHEMA, old)
    calls.hint("rebalance", "month").write.partitionBy("month").parquet(parts.folder(out, "calls", name))
    totals = parts.read(spark, out, "totals", TOTAL_SCHEMA, old)
    usage_merge(totals, totals.limit(0), ["month", "payer"]).write.parquet(parts.folder(out, "totals", name))


def months_of(rows: DataFrame, at_most: int = MAX_MONTHS) -> list[str | None] | None:
    """The distinct months of a batch, or None if there are more than ``at_most``."""
    found = [r.month for r in rows.select("month").distinct().limit(at_most + 1).collect()]
    return found if len(found) <= at_most else None


def known_calls(spark: SparkSession, out: str, manifest: parts.Manifest, months: list[str | None] | None) -> DataFrame:
    """The stored calls of ``months`` (None: of all); other months' folders are pruned when the plan is made."""
    calls = parts.read(spark, out, "calls", CALL_SCHEMA, manifest.parts)
    if months is None:
        return calls
    wanted = F.col("month").isin([m for m in months if m is not None])
    return calls.where(wanted | F.col("month").isNull() if None in months else wanted)


def read_calls(spark: SparkSession, out: str) -> DataFrame:
    """The call log: event_id, payer, month."""
    return parts.read(spark, out, "calls", CALL_SCHEMA, parts.current(spark, out).parts)


def usage_counts(spark: SparkSession, out: str) -> DataFrame:
    """(month, payer, usage_count): the stored totals of all parts in force."""
    return stored_totals(spark, out)
