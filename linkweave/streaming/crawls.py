"""ST2: continuous crawl-and-store from a feed of target names.

Each micro-batch crawls its targets on the graph and adds the result to a crawl log as one
part (``sinks.parts``); a replayed batch finds its epoch there and changes nothing. Full levels of
parts are merged after each batch, so the log is read from a number of folders that grows
with the logarithm of the batches. The store is read back with K6 semantics: for each (target, release) the
newest epoch wins. ``sinks.store.vacuum_crawl_log`` removes what merging has replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave.operators.graph import DEFAULT_BUCKETS
from linkweave.sinks.store import crawl_log, write_crawl_epoch


def run_crawl_stream(targets: DataFrame, vertices: DataFrame, edges: DataFrame, log_root: str, release: str,
                     as_of, checkpoint: str, n_buckets: int = DEFAULT_BUCKETS) -> None:
    """``targets`` is a streaming DataFrame with a `target` column."""
    log_root = log_root.rstrip("/")

    def write(batch: DataFrame, epoch_id: int) -> None:
        write_crawl_epoch(log_root, epoch_id, [dict(targets=batch, vertices=vertices, edges=edges,
                                                    release=release, as_of=as_of)], n_buckets)

    q = (targets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_crawl_log(spark: SparkSession, log_root: str) -> tuple[DataFrame, DataFrame]:
    """(crawls, backlinks) of the log, newest epoch per (target, release)."""
    return crawl_log(spark, log_root)
