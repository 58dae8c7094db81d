"""Rank ingest with its summary (Q8, A10, K7): the counts are observed while the table is written, and kept as rows.

One job reads the dump, writes the new rank table aside and counts on the way: lines read, malformed lines, rows beyond the
limit, rows replaced by a later one of the same domain, rows kept. The counts are added to the run log, which is
published together with the table, so a table in force has its log row and a run that dies has neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.scores import TOTAL_DOMAINS
from linkweave.functions.timekeys import as_of as as_of_col
from linkweave.operators.ranks import DEFAULT_RANK_LIMIT, RANK_COLS, ranks_from_rows, top_ranks
from linkweave.session import literal_rows
from linkweave.sinks import parts
from linkweave.sources.tables import RANKS_SCHEMA
from linkweave.sources.text import parse_rank_lines

RUN_SCHEMA = "run long, ingested_at timestamp_ntz, rows_read long, malformed long, over_limit long, replaced long, kept long"


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def ingest_rank_dump(lines: DataFrame, root: str, limit=DEFAULT_RANK_LIMIT, total=TOTAL_DOMAINS, as_of=None) -> parts.Manifest:
    """Replace the rank table under ``root`` by the rank lines (`value`), and log the run."""
    spark = lines.sparkSession

    def write(name: str) -> None:
        read, seen = _counted(lines, "rank_lines")
        parsed, fit = _counted(parse_rank_lines(read), "rank_rows")
        top, below = _counted(top_ranks(parsed, limit), "rank_top")
        kept, last = _counted(ranks_from_rows(top, limit, total, as_of).select(*RANK_COLS), "rank_kept")
        kept.sortWithinPartitions("domain").write.option("compression", "zstd").parquet(parts.folder(root, "ranks", name))
        n_read, n_fit, n_below, n_kept = (x.get["n"] for x in (seen, fit, below, last))
        before = run_log(spark, root)
        row = literal_rows(spark, [(n_read, n_read - n_fit, n_fit - n_below, n_below - n_kept, n_kept)],
                           "rows_read long, malformed long, over_limit long, replaced long, kept long")
        number = F.lit(before.count())  # one row per run
        row = row.select(number.cast("long").alias("run"), as_of_col(as_of).alias("ingested_at"), *row.columns)
        before.unionByName(row).coalesce(1).write.parquet(parts.folder(root, "runs", name))

    return parts.replace(spark, root, write)


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """A10: one row per ingest of the table in force."""
    return parts.read(spark, root, "runs", RUN_SCHEMA, parts.current(spark, root).parts)


def ingested_ranks(spark: SparkSession, root: str) -> DataFrame:
    """The rank table in force."""
    return parts.read(spark, root, "ranks", RANKS_SCHEMA, parts.current(spark, root).parts)
