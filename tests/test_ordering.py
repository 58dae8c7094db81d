"""with_positions: per-key positions without a per-key window, equal to row_number on skewed data."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkweave.operators.ordering import with_positions


def test_positions_match_row_number_on_a_hot_key(spark):
    # Key 'hot' holds 90% of the rows; with 16 range partitions it spans most of them.
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
        .otherwise(F.lit("hot")).alias("key"),
        (F.col("id") * 7919 % 1000).alias("score"), F.col("id").alias("tie"))
    order = [F.desc("score"), F.asc("tie")]
    got = with_positions(df, ["key"], order, partitions=16)
    w = Window.partitionBy("key").orderBy(*order)
    want = df.withColumn("pos", F.row_number().over(w).cast("long"))
    assert got.count() == 5000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    spread = got.where("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert spread > 1
