"""The registered queries and the pipeline."""
import hashlib
import math

import duckdb
import helpers as H
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from linkweave.llm import langid
from linkweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_every_operator_is_registered():
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    want = con.sql(ORACLE_SQL[key])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    norm = lambda v: repr(round(v, 9)) if isinstance(v, float) and math.isfinite(v) else repr(v)
    at = [want.columns.index(c) for c in cols]
    assert sorted("|".join(norm(r[c]) for c in cols) for r in df.collect()) == \
        sorted("|".join(norm(r[i]) for i in at) for r in want.fetchall())


def test_stages_against_brute_force(spark, tmp_dir):
    items = [(1, " ".join(H.SHARED.split()[:30])), (2, None), (3, "x " * 3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = H.documents(spark)
    columns = docs.columns
    data = {r.doc_id: r for r in docs.collect()}
    net = langid.train(docs)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "mix_sources", "token_output"]
    want = set()
    for d, r in data.items():  # 1: a letter and a language
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        p = net.document_probabilities(raw, np.array([0, len(raw)]))[0]
        if any(c.isalpha() for c in r.text or "") and p.max() >= 0.3:
            want.add(d)
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tmp_dir)
        out.write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
        got = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if i < 4:
            assert docs.columns == columns
        if i == 1:  # 2: one document of each group
            comp = H.jaccard([(d, data[d].text) for d in want], 5, 80, 100)
            want = {d for d in want if comp[d][1] == d}
        if i == 2:  # 3: no benchmark item
            q = H.shingle_set(items[0][1], 5)
            want = {d for d in want if 10 * len(q & H.shingle_set(data[d].text, 5)) < 8 * len(q)}
        if i == 3:  # 4: the draw
            assert set(got) <= want and 0 < len(got) < len(want)
            want = set(got)
        assert got == sorted(want)
        seen.append(len(got))
    assert seen[0] < len(data) and seen[1] < seen[0] and seen[2] < seen[1] and seen[4] == seen[3]
    last = docs.orderBy("start").collect()
    assert [r.doc_id for r in last] == sorted(want) and all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:]))


def test_stages_on_an_empty_table(spark, tmp_dir):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = H.empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tmp_dir)
        assert docs.count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert 0 < len(rows) < 200 and rows[0].start == 0 and all(a.doc_id < b.doc_id for a, b in zip(rows, rows[1:]))
    digest = lambda rows: hashlib.sha256(repr([tuple(r) for r in rows]).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, SF).orderBy("start").collect()) == digest(rows)


def test_near_duplicates_keep_any_column_names(spark):
    data = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "another text of a few words here"), (None, "a b c d e f g")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "doc_id AS pipeline_nth", "text AS `a.b`", "1 AS `c``d`")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(
        str(r) for r in docs.distinct().collect() if r.doc_id != 2)
