"""ST1-ST3: streaming results equal the batch results; replays are idempotent."""
import os

from pyspark.sql import functions as F

from linkweave.operators.usage import usage_by_payer
from linkweave.operators.ranks import ingest_ranks
from linkweave.streaming.crawls import read_crawl_log, run_crawl_stream
from linkweave.streaming.ranks import rank_line_stream, read_rank_log, run_rank_stream
from linkweave.streaming.usage import charged_calls, run_usage_stream, usage_counts
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def test_stream_usage_equals_batch(spark, tmp_dir):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    log = src.select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("payer"),
                     (F.col("event_type") == "purchase").alias("charged"))
    run_usage_stream(charged_calls(log), f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    streamed = usage_counts(spark, f"{tmp_dir}/out")
    batch_log = spark.read.parquet(f"{SF}/events.parquet").select(
        "event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("payer"),
        (F.col("event_type") == "purchase").alias("charged"))
    assert rows(streamed, "month", "payer", "usage_count") == rows(usage_by_payer(batch_log), "month", "payer", "usage_count")
    # A restart with the same checkpoint has nothing new to do and keeps the result.
    again = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF).select(
        "event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("payer"),
        (F.col("event_type") == "purchase").alias("charged"))
    before = rows(streamed, "month", "payer", "usage_count")
    run_usage_stream(charged_calls(again), f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    assert rows(usage_counts(spark, f"{tmp_dir}/out"), "month", "payer", "usage_count") == before


def test_late_and_repeated_calls_count_once(spark, tmp_dir):
    schema = "event_id long, ts timestamp_ntz, payer string, charged boolean"
    arrivals = [[(1, "2026-03-10", "a"), (2, "2026-03-20", "a")], [(3, "2026-03-11", "a"), (1, "2026-03-10", "a")],
                [(4, "2025-12-01", None), (4, "2025-12-01", None)]]
    for i, part in enumerate(arrivals):
        data = spark.createDataFrame(part, "event_id long, ts string, payer string").selectExpr(
            "event_id", "CAST(ts AS timestamp_ntz) AS ts", "payer", "true AS charged")
        data.write.parquet(f"{tmp_dir}/in/batch={i}")
        feed = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/in")
        run_usage_stream(charged_calls(feed), f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    assert rows(usage_counts(spark, f"{tmp_dir}/out"), "month", "payer", "usage_count") == sorted(
        [("2026-03", "a", 3), ("2025-12", None, 1)], key=repr)


def test_a_later_rank_replaces_the_earlier_one(spark, tmp_dir):
    import pathlib
    pathlib.Path(f"{tmp_dir}/landing").mkdir()
    for i, rank in enumerate((50, 10, 70)):
        pathlib.Path(f"{tmp_dir}/landing/{i}.txt").write_text(f"{rank}\t1.0\t1\t0.1\tcom.moves\t3\n")
        run_rank_stream(rank_line_stream(spark, f"{tmp_dir}/landing"), f"{tmp_dir}/log", f"{tmp_dir}/ck", limit=100, total=100)
        assert [r.harmonic_rank for r in read_rank_log(spark, f"{tmp_dir}/log").collect()] == [rank]


def test_stream_crawls_and_ranks(spark, tmp_dir):
    v = spark.createDataFrame([(1, "com.t", 1), (2, "org.a", 5), (3, "org.b", 6)], "id long, rev_domain string, num_hosts long")
    e = spark.createDataFrame([(2, 1), (3, 1)], "from_id long, to_id long")
    os.makedirs(f"{tmp_dir}/feed")
    spark.createDataFrame([("t.com",), ("none.com",)], "target string").write.parquet(f"{tmp_dir}/feed/a")
    feed = spark.readStream.schema("target string").parquet(f"{tmp_dir}/feed/a")
    run_crawl_stream(feed, v, e, f"{tmp_dir}/log", "r1", "2026-01-01 00:00:00", f"{tmp_dir}/ck1")
    c, b = read_crawl_log(spark, f"{tmp_dir}/log")
    assert rows(c, "target", "result_count") == [("none.com", 0), ("t.com", 2)]
    assert b.count() == 2

    with open(f"{tmp_dir}/lines.txt", "w") as fh:
        fh.write("#h\n1\t1.0\t1\t0.1\tcom.a\t3\n2\t1.0\t1\t0.1\tcom.b\t3\n3\t1.0\t1\t0.1\tcom.a\t4\nbad\n")
    os.makedirs(f"{tmp_dir}/landing")
    os.rename(f"{tmp_dir}/lines.txt", f"{tmp_dir}/landing/lines.txt")
    run_rank_stream(rank_line_stream(spark, f"{tmp_dir}/landing"), f"{tmp_dir}/rlog", f"{tmp_dir}/ck2",
                    limit=10, total=100, as_of="2026-01-01 00:00:00")
    streamed = read_rank_log(spark, f"{tmp_dir}/rlog")
    batch = ingest_ranks(spark.read.text(f"{tmp_dir}/landing"), limit=10, total=100, as_of="2026-01-01 00:00:00")
    assert rows(streamed) == rows(batch) and streamed.count() == 2
