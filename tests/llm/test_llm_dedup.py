"""Jaccard join, chunk spans, decontamination, line runs and embeddings against brute force."""
import hashlib
import pathlib
import random
from collections import Counter

import helpers as H
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkweave.llm import chunk_dedup, decontaminate, embedding_dedup, jaccard_join, line_dedup
from linkweave.session import scratch_tables


@pytest.mark.parametrize("k,num,den,small,block", [(3, 90, 100, 48, 256), (5, 80, 100, 2, 3), (2, 8, 10, 1, 4)])
def test_jaccard_classes(spark, k, num, den, small, block):
    got = jaccard_join.jaccard_classes(H.documents(spark), k, num, den, 8, small, block).collect()
    want = H.jaccard([(r[0], r[1]) for r in H.rows()], k, num, den)
    assert {r[0]: (r[1], r[2]) for r in got} == want and len(got) == len(want)


def test_jaccard_hot_region_of_unlinked_documents(spark):
    """Many short documents share one passage but are not alike: blocks compare them without losing the few that are."""
    rnd = random.Random(3)
    data = [(i, " ".join(f"w{rnd.randrange(9000)}" for _ in range(14)) + " " + " ".join(H.SHARED.split()[:12]), None, None, None) for i in range(150)]
    data += [(1000 + i, data[i][1] + " more", None, None, None) for i in range(20)]
    got = jaccard_join.jaccard_classes(H.documents(spark, data), 3, 85, 100, 6, 3, 16).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == H.jaccard([(r[0], r[1]) for r in data], 3, 85, 100)


def test_jaccard_levels_lose_nothing(spark):
    """With no bucket order to lean on, a quoted passage fills the first pivots; its regions are left a level later."""
    rnd = random.Random(5)
    quote = " ".join(H.SHARED.split()[:30])
    data = [(i, quote + " " + " ".join(f"w{rnd.randrange(9000)}" for _ in range(40)), None, None, None) for i in range(60)]
    data += [(500 + i, data[i][1] + " more", None, None, None) for i in range(10)]
    want = H.jaccard([(r[0], r[1]) for r in data], 3, 80, 100)
    for levels in (0, 3):
        got = jaccard_join.jaccard_classes(H.documents(spark, data), 3, 80, 100, 1, 4, 16, levels=levels).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == want


def quoting(n, words, seed=7):
    """Documents that quote one passage at length and share nothing else."""
    rnd = random.Random(seed)
    quote = " ".join(H.SHARED.split()[:30])
    return [(i, quote + " " + " ".join(f"w{rnd.randrange(90000)}" for _ in range(words)), None, None, None) for i in range(n)]


def test_jaccard_levels_end_when_nothing_changes(spark):
    """Sets with hardly a shingle beside the passage cannot leave its regions: a second level is not taken, no pair is compared twice."""
    data = quoting(40, 4)
    before = set(scratch_tables(spark))
    got = jaccard_join.jaccard_classes(H.documents(spark, data), 3, 80, 100, 1, 4, 16).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == H.jaccard([(r[0], r[1]) for r in data], 3, 80, 100)
    made = [t for t in scratch_tables(spark) if t not in before]
    assert sum("/jaccard-moved-" in t for t in made) == 1
    near = [tuple(r) for t in made if "/jaccard-near-" in t for r in spark.read.parquet(t).collect()]
    assert near and len(near) == len(set(near))


def test_jaccard_late_pivots_add_to_those_before(spark):
    """The pivots kept from before and those added are, together and without repeats, the first pivots under the new order."""
    data = [(100 + r[0], *r[1:]) for r in quoting(1, 0)] + quoting(20, 40)
    docs = jaccard_join._rows(H.documents(spark, data))
    load = np.zeros(2, np.uint32)
    pivots = lambda df: {r.doc_id: np.array(r.pivots, np.int64) for r in df.collect()}
    bits = lambda some: jaccard_join.region_filter(spark.createDataFrame([(int(x),) for x in some], "region bigint"))
    passes = lambda f, x: jaccard_join.passes(f, x & jaccard_join.LOW)
    layers = [(pivots(jaccard_join.replicas(docs, 3, 80, 100, load, 1)), None)]
    held = sorted({x for v in layers[0][0].values() for x in v.tolist()})
    texts = pa.RecordBatch.from_pydict({"text": [r[1] for r in data]})
    sets = dict(zip([r[0] for r in data], jaccard_join._sets(texts, 3)))
    first, second = bits(held[::3]), bits(held[::3] + held[1::5])
    for late, before in ((first, None), (second, first)):
        layers.append((pivots(jaccard_join.replicas(docs, 3, 80, 100, load, 1, late, before)), late))
        for doc, s in sets.items():
            take = len(s) - -(-80 * len(s) // 100) + 1
            now = passes(late, s.view(np.int64))
            want = np.concatenate([s[~now], s[now]])[:take].view(np.int64)
            got = []
            for layer, then in layers:
                gone = passes(late, layer[doc]) & (~passes(then, layer[doc]) if then is not None else True)
                got += layer[doc][~gone].tolist()
            assert sorted(got) == sorted(want.tolist())


def test_jaccard_pivots_of_copies_are_left_out(spark):
    """Only a class's own row keeps pivots, although ids repeat and a full filter lets every row through."""
    data = [(i, f"a{i % 4} b c d e f{i % 4}", None, None, None) for i in range(12)] + [(0, "quite another text here", None, None, None)]
    docs = jaccard_join._rows(H.documents(spark, data + [(None, "a0 b c d e f0", None, None, None)]))
    own = jaccard_join.profiles(docs, 3, 4).where("n IS NOT NULL").select("doc_id", "n", "d1", "d2")
    nodes = own.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node")).where("node < 4 AND node IS NOT NULL")
    load = np.zeros(16, np.uint32)
    whole = jaccard_join.id_filter
    for filled in (False, True):
        if filled:
            jaccard_join.id_filter = lambda places: np.full_like(whole(places), ~np.uint64(0))
        try:
            placed = jaccard_join.representatives(docs, own, nodes, 3, 90, 100, load, 4)
        finally:
            jaccard_join.id_filter = whole
        assert sorted(r.node for r in placed.collect()) == [0, 0, 1, 2, 3]


def test_regions_in_common():
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 9000, rng.integers(1, 60))) for _ in range(n)] for n in (40, 30))
    want = np.array([[bool(set(x.tolist()) & set(y.tolist())) for y in right] for x in left])
    assert (jaccard_join.meeting(left, right) == want).all() and want.any() and not want.all()
    assert not jaccard_join.meeting([np.array([1])], [np.array([2])]).any()


def test_jaccard_odd_rows(spark):
    data = [(5, "a b c d", None, None, None), (5, "a b c d", None, None, None), (None, "a b c d", None, None, None),
            (None, "alone here now", None, None, None), (9, None, None, None, None), (9, "A  B\nc d", None, None, None)]
    got = sorted(map(tuple, jaccard_join.jaccard_classes(H.documents(spark, data)).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (9, 0, 9), (9, 2, 5)], key=repr)
    assert jaccard_join.jaccard_classes(H.empty_documents(spark)).count() == 0


def test_repeated_passage_is_found_and_shifts_do_not_matter(spark):
    passage = " ".join(H.SHARED.split()[:51])
    rnd = random.Random(8)
    noise = lambda n: " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}" for _ in range(n))
    data = [(i, noise(60 + i) + " " * (i % 3 + 1) + passage + " " + noise(40), None, None, None) for i in range(30)]
    data += [(1000 + i, noise(120), None, None, None) for i in range(60)]
    data += [(2000, data[3][1], None, None, None), (2001, None, None, None, None), (2002, "", None, None, None), (None, data[3][1], None, None, None)]
    spans = chunk_dedup.repeated_spans(H.documents(spark, data)).collect()
    assert {r.doc_id for r in spans} == set(range(1, 30)) | {2000}
    assert all(r.first_doc_id < r.doc_id for r in spans)
    texts = {r[0]: r[1] for r in data}
    for r in spans:
        part = texts[r.doc_id].encode()[r.start_byte:r.end_byte].decode()
        assert abs(len(part.split()) - r.n_words) <= 2
        assert r.doc_id == 2000 or part in texts[r.first_doc_id]  # 2000 repeats chunks of two documents
    whole = next(r for r in spans if r.doc_id == 2000)
    assert (whole.start_byte, whole.end_byte) == (0, len(data[3][1]))


def test_every_passage_of_just_over_fifty_words_is_found(spark):
    """Several hundred passages of 51 words, down to one letter a word, in hosts that differ."""
    rnd = random.Random(21)
    noise = lambda n: " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}" for _ in range(n))
    data, want = [], {}
    for i in range(400):
        letters = 1 + i % 8
        passage = " ".join("".join(rnd.choices("eitaonsr", k=rnd.randint(1, letters))) for _ in range(51))
        host = noise(rnd.randint(0, 30))
        data.append((i, noise(rnd.randint(1, 30)) + "\n" + passage + "\n" + noise(20), None, None, None))
        data.append((1000 + i, host + "\t" + passage + "\t" + noise(20), None, None, None))
        want[1000 + i] = (i, len(host) + 1, len(host) + 1 + len(passage), 51)
    got = chunk_dedup.repeated_spans(H.documents(spark, data)).collect()
    assert {r.doc_id: (r.first_doc_id, r.start_byte, r.end_byte, r.n_words) for r in got} == want and len(got) == len(want)
    short = [(d, t.replace(t.split()[-21], "cut", 1), *rest) for d, t, *rest in data if d >= 1000]
    assert chunk_dedup.repeated_spans(H.documents(spark, data[::2] + short), min_words=52).count() == 0


def test_passage_under_a_repeated_doc_id_and_runs_of_one_byte(spark):
    passage = " ".join(H.SHARED.split()[:51])
    data = [(1, "one text " + passage + " ends", None, None, None), (1, "quite another text of this name", None, None, None),
            (2, "x" * 5000, None, None, None), (3, "y " + "x" * 5000 + " z", None, None, None),
            (4, "other words", None, None, None), (4, "A " + passage + ". B", None, None, None)]
    got = chunk_dedup.repeated_spans(H.documents(spark, data)).collect()
    assert [(r.doc_id, r.first_doc_id, r.n_words) for r in got] == [(4, 1, 50)]  # the last word goes on with a full stop
    assert len(chunk_dedup.seed_starts(np.frombuffer(b"x" * 50_000, np.uint8), np.array([0, 50_000]))) < 3000


def test_chunk_bounds_resist_insertions():
    rnd = random.Random(1)
    text = " ".join(f"{rnd.randrange(10**5)}" for _ in range(4000)).encode()
    raw = np.frombuffer(text, np.uint8)
    shifted = np.frombuffer(text[:5000] + b"inserted bytes" + text[5000:], np.uint8)
    cut = lambda x: [bytes(x[a:b]) for a, b in zip([0, *chunk_dedup.chunk_bounds(x)], chunk_dedup.chunk_bounds(x))]
    a, b = cut(raw), cut(shifted)
    assert b"".join(a) == text
    assert sum((Counter(b) - Counter(a)).values()) <= 6
    assert all(len(c) <= chunk_dedup.MAX_CHUNK for c in a)


def test_chunk_odd_tables_and_drop(spark):
    docs = H.documents(spark)
    spans = chunk_dedup.repeated_spans(docs)
    cut = {r.doc_id: r.text for r in chunk_dedup.drop_spans(docs, spans).collect()}
    kept = {r[0]: r[1] for r in H.rows()}
    gone = {r.doc_id for r in spans.collect()}
    assert gone and all((cut[d] == kept[d]) == (d not in gone) for d in kept)
    assert chunk_dedup.drop_spans(docs, spans).columns == docs.columns
    assert chunk_dedup.repeated_spans(H.empty_documents(spark)).count() == 0


def items(spark, data):
    return spark.createDataFrame(data, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS keys")


def test_contaminated_equals_exact_containment(spark):
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    tests = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([3, 5, 9, 20, 21, 33, 60, 130])))) for i in range(40)]
    tests += [(100, None), (101, ""), (102, "One"), (103, tests[5][1]), (None, tests[6][1])]
    docs = [(r[0], r[1], None, None, None) for r in H.rows()]
    for i in range(60):
        words = rnd.choices(vocab, k=rnd.choice([0, 5, 50, 400]))
        own = tests[rnd.randrange(40)][1].split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            own[rnd.randrange(len(own))] = "changed"
        at = rnd.randrange(len(words) + 1)
        docs.append((10_000 + i, " ".join(words[:at] + own + words[at:]), None, None, None))
    docs.append((20_000, " ".join(rnd.choices(vocab, k=60_000)) + " " + tests[3][1] + " " + tests[4][1], None, None, None))
    want = set()
    for d, t, *_ in docs:
        s = H.shingle_set(t, 5)
        for i, x in tests:
            q = H.shingle_set(x, 5)
            if q and 10 * len(q & s) >= 8 * len(q):
                want.add((d, i, len(q & s), len(q)))
    got = decontaminate.contaminated(H.documents(spark, docs), items(spark, tests)).collect()
    assert {(r[0], r[1], r[2], r[3]) for r in got} == want and len(want) > 20
    clean = decontaminate.decontaminate(H.documents(spark, docs), items(spark, tests))
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d[0] for d in docs} - {w[0] for w in want})
    assert clean.columns == H.documents(spark, docs).columns


def test_every_short_item_is_found_in_long_documents(spark):
    """Items of 1 to 16 shingles, verbatim or with the last word changed, far inside longer documents; short items alone too."""
    rnd = random.Random(14)
    noise = lambda n: " ".join(f"n{rnd.randrange(10**7)}" for _ in range(n))
    tests = [(i, " ".join(f"t{rnd.randrange(10**6)}" for _ in range(5 + i % 16 if i >= 200 else 5))) for i in range(400)]
    docs, want = [], set()
    for i, t in tests:
        q = len(t.split()) - 4
        docs.append((i, noise(200) + " " + t + " " + noise(200), None, None, None))
        want.add((i, i, q, q))
        docs.append((1000 + i, noise(90) + " " + " ".join(t.split()[:-1]) + " changed " + noise(90), None, None, None))
        if 10 * (q - 1) >= 8 * q:
            want.add((1000 + i, i, q - 1, q))
    long_item = (900, noise(70))
    docs.append((5000, noise(100) + " " + long_item[1], None, None, None))
    for extra, more in (([], set()), ([long_item], {(5000, 900, 66, 66)})):
        got = decontaminate.contaminated(H.documents(spark, docs), items(spark, tests + extra)).collect()
        assert {(r[0], r[1], r[2], r[3]) for r in got} == want | more and len(got) == len(want | more)


def test_contaminated_odd_tables(spark):
    some = items(spark, [(1, "One"), (2, None)])
    assert decontaminate.contaminated(H.empty_documents(spark), some).count() == 0
    assert decontaminate.contaminated(H.documents(spark), some.limit(0)).count() == 0
    assert decontaminate.decontaminate(H.documents(spark), some.where("item_id = 2")).count() == len(H.rows())
    twice = [(None, "One", None, None, None), (4, "one", None, None, None), (4, "one", None, None, None), (5, "one two", None, None, None)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(H.documents(spark, twice), some).collect()) == [5]


def lines_by_hand(data, min_chars, min_docs):
    key = lambda line: H.lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in data:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in data:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout,heavy", [(1, 2, 1), (5, 2, 10_000), (9, 3, 4)])
def test_line_dedup(spark, batches, fanout, heavy):
    data = H.rows() + [(3, "  A LINE that is long enough to be counted as a key by itself", None, None, None),
                       (None, "A line that is long enough to be counted as a key by itself", None, None, None)]
    got = sorted(map(tuple, line_dedup.dedup_lines(H.documents(spark, data), 20, 5, batches, fanout, heavy).collect()), key=repr)
    assert got == lines_by_hand([(r[0], r[1]) for r in data], 20, 5)
    assert sum(r[2] for r in got) > 5


def test_line_dedup_empty_and_runs(spark):
    assert line_dedup.dedup_lines(H.empty_documents(spark)).count() == 0
    runs = line_dedup.LineRuns(fanout=2)
    for batch in ([("a", 9), ("b", 9)], [("a", 7), ("c", 8)], [("a", 5), ("c", 4)], [("d", 1)], [("a", 0)]):
        runs.add(spark.createDataFrame(batch, "key string, doc_id long"))
    assert len(runs.runs()) <= 3
    assert {r.key: (r.holder, r.n_docs) for r in runs.totals().collect()} == {"a": (9, 4), "b": (9, 1), "c": (8, 2), "d": (1, 1)}


def test_line_runs_take_files_by_rows_not_by_partitions(spark, monkeypatch):
    folders, plain, before = [], line_dedup.scratch_path, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(line_dedup, "scratch_path", lambda s, name: folders.append(plain(s, name)) or folders[-1])
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", 200)
    data = [(i, f"a line that stands in many of the documents, {i % 30}\na line of a single document, which is {i}", None, None, None)
            for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted(map(tuple, line_dedup.dedup_lines(H.documents(spark, data), 20, 5, 2, 4).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == lines_by_hand([(r[0], r[1]) for r in data], 20, 5)
    files = [p for f in folders for p in pathlib.Path(f.removeprefix("file:")).glob("part-*")]
    assert len(folders) == 1 and 2 <= len(files) <= 6  # 600 keys in 3 buckets, two runs


def test_line_runs_are_not_shuffled(spark):
    runs = line_dedup.LineRuns(fanout=4)
    batches = [spark.createDataFrame([("a", i), (str(i), i)], "key string, doc_id long") for i in (9, 8, 7)]
    for batch in batches[:2]:
        runs.add(batch)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the runs of a test are small
    try:
        plan = runs.judged(batches[2])._jdf.queryExecution().executedPlan().toString()
        merged = runs.totals()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan, plan  # the batch's distinct rows and its keys
    assert "Exchange" not in merged, merged


def test_line_dedup_repeated_ids_and_long_blanks(spark):
    line = "this line stands in every one of the documents"
    long = "x" + " " * 1_000_000 + "y"
    data = [(i, f"{i}\n{line}\n{line.upper()}\nend", None, None, None) for i in range(6)]
    data += [(2, f"{line}\nanother text of the same id", None, None, None), (3, data[3][1], None, None, None),
             (7, f"{long}\n{line} \t\n" + " " * 1_000_000 + f"{line}\n", None, None, None)]
    got = sorted(map(tuple, line_dedup.dedup_lines(H.documents(spark, data), 20, 5, 3).collect()), key=repr)
    assert got == lines_by_hand([(r[0], r[1]) for r in data], 20, 5)


def test_line_dedup_query_digest(spark, tmp_dir):
    from linkweave.llm.queries import op10_line_dedup

    H.documents(spark).write.parquet(f"{tmp_dir}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op10_line_dedup(spark, tmp_dir).collect()}
    want = lines_by_hand([(r[0], r[1]) for r in H.rows()], 40, 5)
    assert got == {d: (n, x, hashlib.sha256(t.encode()).hexdigest()) for d, n, x, t in want}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 8))
    data = [(i, [float(v) for v in base[rng.integers(30)] + rng.normal(size=8) * rng.choice([0, .05, .2, .3])]) for i in range(600)]
    data += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0] * 7 + [None]),
             (1005, [1.0] * 7 + [float("inf")]), (1006, [1.0, 2.0]), (1007, [1e30] * 8), (1008, [1e-30] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS node", "3 AS vector")
    out = embedding_dedup.near_duplicates(df)
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    ok = [r for r in df.collect() if r[1] and len(r[1]) == 8 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = np.array([r[1] for r in ok], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    n = {r[0]: int(c) for r, c in zip(ok, s.sum(axis=1))}
    comp = H.components([r[0] for r in data], [(ok[a][0], ok[b][0]) for a, b in zip(*np.nonzero(np.triu(s)))])
    assert got == {i: (n.get(i, 0), comp[i], comp[i] == i) for i, _ in data}
    found = embedding_dedup.audit(df, out).first()
    assert found.recall >= 0.9 and found.n_queries > 20 and found.true_links > 0


def test_pairs_that_the_graph_misses_count_once(spark):
    """Without any edge the search reaches next to nothing; the links are whole and counted in one of the two tasks."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(6, 8)), 20, axis=0) + rng.normal(size=(120, 8)) * .05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(shard, 0, 0, 0, i, x[i].tolist(), [0, 1], 1) for shard in (0, 1) for i in range(120)]
    work = spark.createDataFrame(rows, "shard long, lo long, hi long, own long, node long, vector array<double>, shards array<long>, copies long")
    none = spark.createDataFrame([], "node long, neighbours array<long>")
    got = embedding_dedup.search(work, none, 8, 0.9).groupBy("node").sum("n_links").collect()
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert {r[0]: r[1] for r in got} == dict(enumerate(want.tolist())) and want.min() > 0


def test_embeddings_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]
    twice = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0])]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(spark.createDataFrame(twice, kind)).collect()), key=repr)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (None, 2, None, False), (8, 0, 8, True)], key=repr)


def test_decontamination_does_not_shuffle_the_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "the quick brown fox jumps over"), (3, None), (None, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over")], "item_id bigint, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean = decontaminate.decontaminate(docs, items)
        plan = clean._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r.doc_id or 0) for r in clean.collect()) == [0, 1, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
