"""Connected components: few queries a round, right classes."""

from __future__ import annotations

import random

from linkweave.llm import tables
from pyspark.sql.classic.dataframe import DataFrame


def by_hand(links):
    low = {n: n for e in links for n in e}
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_a_round_takes_one_check(spark, monkeypatch):
    checks, written = [], []
    empty, write = DataFrame.isEmpty, tables.materialize
    monkeypatch.setattr(DataFrame, "isEmpty", lambda self: checks.append(1) or empty(self))
    monkeypatch.setattr(tables, "materialize", lambda df, name: written.append(name) or write(df, name))
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(10, 30)] + [(100, x) for x in range(90, 110) if x != 100]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links = [(a, b) for a, b in links if a != b]
    got = tables.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == by_hand(links) and len(got) == len(by_hand(links))
    assert len(checks) == len(written) > 2  # each round's table is looked at once


def test_no_new_links_leave_the_components(spark):
    found = spark.createDataFrame([(1, 1), (2, 1)], "node long, component long")
    assert tables.joined_components(found, spark.createDataFrame([], "a long, b long"), "none") is found
    more = tables.joined_components(found, spark.createDataFrame([(2, 7)], "a long, b long"), "more").collect()
    assert sorted(map(tuple, more)) == [(1, 1), (2, 1), (7, 1)]
