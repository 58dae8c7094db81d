"""DR score and authority score."""
import math

import pytest
from pyspark.sql import functions as F

from linkweave.functions import authority_or_null, authority_score, derive_dr


def _dr(spark, ranks, total=109_000_000):
    df = spark.createDataFrame([(r,) for r in ranks], "r long")
    return [row["d"] for row in df.select(derive_dr(F.col("r"), total).alias("d")).collect()]


def test_dr_ends(spark):
    assert _dr(spark, [1, 0, -40, 109_000_000, 10 ** 15]) == [100, 100, 100, 0, 0]
    assert _dr(spark, [24, 1234]) == [83, 62]  # the formula, not the published examples


@pytest.mark.parametrize("total", [109_000_000, 5_000, 40])
def test_dr_changes_at_the_boundary_ranks(spark, total):
    """A score s covers the ranks between total ** ((99.5 - s) / 100) and total ** ((100.5 - s) / 100)."""
    ranks, want = [], []
    for score in range(1, 100):
        edge = total ** ((100.5 - score) / 100)  # scores above this rank are below `score`
        below, above = math.floor(edge - 1e-6), math.ceil(edge + 1e-6)
        if 1 < below and above < total and below >= total ** ((99.5 - score) / 100) + 1e-6:
            ranks += [below]
            want += [score]
        if above < total and above <= total ** ((101.5 - score) / 100) - 1e-6 and score > 1:
            ranks += [above]
            want += [score - 1]
    assert len(ranks) > 5 and _dr(spark, ranks, total) == want


def test_dr_never_rises_with_the_rank(spark):
    got = _dr(spark, [3 ** k for k in range(17)])
    assert all(a > b for a, b in zip(got, got[1:]))


def test_dr_null_and_column_total(spark):
    df = spark.createDataFrame([(None, 10), (5, 10)], "r long, t long")
    out = [r["d"] for r in df.select(derive_dr(F.col("r"), F.col("t")).alias("d")).collect()]
    assert out == [None, 30]


def test_authority_literals(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, -1.0, 10.0, 100.0, 1000.0, 1e20, 1e100]], "n double")
    out = [r["a"] for r in df.select(authority_score(F.col("n")).alias("a")).collect()]
    assert out == [0, 0, 15, 30, 45, 100, 100]


def test_authority_monotonic_and_null(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 5, 10, 50, 100, 10 ** 6, 10 ** 7]], "n long")
    out = [r["a"] for r in df.select(authority_score(F.col("n")).alias("a")).collect()]
    assert out == sorted(out)
    nulls = spark.createDataFrame([(None,), (0,), (-3,), (10,)], "n long").select(
        authority_score(F.col("n")).alias("a"), authority_or_null(F.col("n")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in nulls] == [(None, None), (0, None), (0, 0), (15, 15)]
