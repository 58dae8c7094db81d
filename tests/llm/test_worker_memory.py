"""Memory that a Python worker takes for one batch: two workers and a heap of 1.8 GB share 3 GB of an executor."""

from __future__ import annotations

import os
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from linkweave.llm import collocations, hmm, token_output
from linkweave.llm.queries import tokenizer_file
from linkweave.llm.words import pieces

MB = 1 << 20


def texts(size: int, words: int, seed: int = 0) -> pa.RecordBatch:
    """About ``size`` bytes of text in rows of 3,000 bytes."""
    rng = np.random.default_rng(seed)
    names = np.array([f"{x:x}" for x in rng.integers(1 << 16, 1 << 24, words)])
    rows = [" ".join(names[rng.integers(0, words, 430)].tolist()) for _ in range(size // 3000)]
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(["en"] * len(rows))], ["text", "lang"])


def peak_mb(work) -> float:
    work()  # tables that are made once
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_shard_of_phrases_takes_little_memory():
    batch = texts(20 * MB, 20_000)
    known = np.full(1 << 21, 0xFFFFFFFFFFFFFFFF, np.uint64)
    found = []

    def work() -> None:
        found.clear()
        for words in collocations._batches(iter([batch])):
            found.append(sum(int(n.sum()) for _, _, n in collocations.Index(words, known).levels(known, 2)))

    assert peak_mb(work) < 120
    assert sum(found) == batch.num_rows * 429  # all pairs of neighbours, none left out


def test_pieces_are_learnt_in_calls_of_bounded_size(monkeypatch):
    monkeypatch.setattr(token_output, "_TABLES", {})
    plain, calls = token_output.PieceTable.encode, []

    def encode(self, some):
        calls.append((len(some), sum(map(len, some))))
        return plain(self, some)

    monkeypatch.setattr(token_output.PieceTable, "encode", encode)
    text = " ".join([str(i) for i in range(100_000, 130_000)] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q" for i in range(17_000)])
    ids, n = token_output.encode_column(pa.array([text, None, "last"]), tokenizer_file(), 0)
    assert max(rows for rows, _ in calls) <= 4096 and max(size for _, size in calls) < 200_000
    monkeypatch.undo()
    table = token_output.piece_table(tokenizer_file())
    assert ids.tolist() == [x for t in (text, "", "last") for x in [*table.encode([t])[0], 0]] and int(n.sum()) == len(ids)


def test_tokenizer_starts_no_threads_in_a_worker():
    code = (
        "import os, sys; sys.path[:0] = sys.argv[1].split(os.pathsep)\n"
        "import pyarrow as pa\n"
        "from linkweave.llm import token_output\n"
        "from linkweave.llm.queries import tokenizer_file\n"
        "before = len(os.listdir('/proc/self/task'))\n"
        "token_output.encode_column(pa.array([f'word{i} na\u4e2dve {i}' for i in range(500)]), tokenizer_file(), 0)\n"
        "print(len(os.listdir('/proc/self/task')) - before)\n")
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    env["RAYON_NUM_THREADS"] = "4"
    out = subprocess.run([sys.executable, "-c", code, os.pathsep.join(sys.path)], env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "0", out.stdout + out.stderr


def test_rows_of_blocks_are_small(spark):
    """Three pieces with more words than two bytes can number; a task holds each of their rows several times over."""
    rng = np.random.default_rng(5)
    names = np.array([f"{x:x}" for x in np.unique(rng.integers(1 << 16, 1 << 24, 90_000))])
    data = [(i, " ".join(names[rng.integers(0, len(names), 1_300)].tolist())) for i in range(360)]
    docs = hmm.hold_out(spark.createDataFrame(data, "doc_id long, text string").coalesce(1))
    rows = hmm.blocks(docs, "hmm_held_out").toArrow()
    assert max(rows.slice(i, 1).nbytes for i in range(rows.num_rows)) < 700_000
    held = {r.doc_id for r in docs.where("hmm_held_out").collect()}
    count = Counter(w for d, text in data if d not in held for w in text.split())
    train = sum(count.values()) + len(data) - len(held)
    out = {r.doc_id: r for r in hmm.score(docs, "hmm_held_out", states=2, bits=5, passes=1).collect()}
    assert out.keys() == dict(data).keys()
    for d, text in data:
        words = text.split()
        base = sum(np.log10((n + 0.1) / (train + 0.1 * (len(count) + 2))) for n in [*(count[w] for w in words), len(data) - len(held)])
        r = out[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(count[w] > 0 for w in words) + 1, train)
        assert abs(r.base_score - base) < 1e-6 and np.isfinite(r.score) and r.score < 0


def test_block_of_texts_takes_little_memory():
    batch = texts(8 * MB, 120_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text"), pa.array([False] * batch.num_rows)],
                                       ["doc_id", "text", "held_out"])
    found = []

    def work() -> None:
        found.clear()
        block = hmm._Block()
        for b in pieces(iter([batch]), hmm.PIECE):
            block.add(b)
        for row in block.rows(0, 11):
            if row.column("seq")[0].is_valid:
                tokens, lengths = hmm._training(row, 0, 11)
                found.append((len(tokens), int(lengths.sum())))

    assert peak_mb(work) < 60
    assert sum(n for n, _ in found) == sum(n for _, n in found) == batch.num_rows * 431


def test_packed_ids_come_back():
    rng = np.random.default_rng(6)
    for size in (1, 2, 65_536, 65_537, 300_000, 1 << 25):
        for n in (1, 7, 8, 1_000):
            ids = np.append(rng.integers(0, size, n - 1), size - 1)
            raw = hmm.packed(ids, size)
            assert (hmm.unpacked(raw, n) == ids).all() and len(raw) <= 2 * n + (max(16, (size - 1).bit_length()) - 16) * (n + 7) // 8 + 9
