"""ST3: continuous rank-line ingest from a landing folder.

New text files are parsed (F9), cut to the top N (P4) and scored (F6) per micro-batch and added to
a rank table as one part (``sinks.parts``; a replayed batch changes nothing). A later batch
replaces a domain's row, better or worse; inside one batch last-write-wins (K8) keeps the row with the largest
harmonic rank, as in a rank-sorted dump. Full levels are merged after each batch, which leaves one row per domain
and part, and ``fold_rank_log`` folds everything into one published table, from which domains are read as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.functions.scores import TOTAL_DOMAINS
from linkweave.operators.dedupe import dedupe_last
from linkweave.operators.ranks import DEFAULT_RANK_LIMIT, RANK_COLS, ranks_from_rows
from linkweave.sinks import parts
from linkweave.sources.tables import RANKS_SCHEMA
from linkweave.sources.text import parse_rank_lines

LOG_SCHEMA = T.StructType([*RANKS_SCHEMA.fields, T.StructField("epoch", T.LongType())])


def rank_line_stream(spark: SparkSession, landing: str) -> DataFrame:
    return spark.readStream.option("lineSep", "\n").text(landing)


def run_rank_stream(lines: DataFrame, log_root: str, checkpoint: str, limit=DEFAULT_RANK_LIMIT,
                    total=TOTAL_DOMAINS, as_of=None) -> None:
    log_root = log_root.rstrip("/")

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        lim = limit(spark) if callable(limit) else limit
        tot = total(spark) if callable(total) else total

        def rows(name: str, _: parts.Manifest) -> None:
            ranks_from_rows(parse_rank_lines(batch), lim, tot, as_of).select(*RANK_COLS, F.lit(epoch_id).cast("long").alias("epoch")) \
                .where(F.col("domain").isNotNull()).write.parquet(parts.folder(log_root, "ranks", name))

        parts.add(spark, log_root, epoch_id, rows)
        parts.merge(spark, log_root, lambda old, name: _merge(spark, log_root, old, name))

    q = (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _newest(spark: SparkSession, log_root: str, of: list[parts.Part] | tuple[parts.Part, ...]) -> DataFrame:
    rows = parts.read(spark, log_root, "ranks", LOG_SCHEMA, of)
    if len(of) == 1:  # one row per domain already
        return rows
    return dedupe_last(rows, ["domain"], ["epoch", "harmonic_rank", "harmonic_val", "pr_rank", "pr_val", "n_hosts"])


def _merge(spark: SparkSession, log_root: str, old: list[parts.Part], name: str) -> None:
    _newest(spark, log_root, old).sortWithinPartitions("domain").write.parquet(parts.folder(log_root, "ranks", name))


def fold_rank_log(spark: SparkSession, log_root: str) -> bool:
    """Fold all parts into one table with one row per domain, and publish it in one step."""
    return parts.fold(spark, log_root, lambda old, name: _merge(spark, log_root, old, name))


def read_rank_log(spark: SparkSession, log_root: str) -> DataFrame:
    """The rank table; of a folded log a plain scan."""
    return _newest(spark, log_root, parts.current(spark, log_root).parts).select(*RANK_COLS)
