"""Hidden Markov model, byte network, block labeller, mixing and token output."""
import math
import zlib
from collections import Counter

import helpers as H
import numpy as np
import pyarrow as pa
import pytest

from linkweave.llm import hmm, html_extract, langid, mixing, simple8b, token_output
from linkweave.llm.queries import tokenizer_file
from linkweave.llm.words import word_hashes


# ---- hidden Markov model

def forward_by_hand(model, x):
    a = model.start * model.emit[:, x[0]]
    for t in x[1:]:
        a = (a @ model.move) * model.emit[:, t]
    return math.log(a.sum())


def small_model(k=3, c=6, seed=1):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))


@pytest.mark.parametrize("segment", [1, 4, 7, 100])
def test_forward_is_exact_over_pieces(segment):
    model = small_model()
    lengths = np.array([1, 2, 5, 9, 30, 17, 4])
    tokens = np.random.default_rng(2).integers(0, 6, lengths.sum())
    got = hmm.log_likelihoods(model, tokens, lengths, segment)
    at = 0
    for length, g in zip(lengths, got):
        assert math.isclose(g, forward_by_hand(model, tokens[at:at + length]), rel_tol=1e-12)
        at += length


def test_rare_classes_stay_in_range():
    """Between two rescalings a run of the rarest classes does not underflow."""
    emit = np.array([[1 - 1e-30, 1e-30, 0.0], [1 - 1e-30, 1e-30, 0.0]])
    model = hmm.Model(np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.full((2, 2), 0.5), emit)
    tokens, lengths = np.ones(700, np.int64), np.array([3, 300, 397])
    assert np.allclose(hmm.log_likelihoods(model, tokens, lengths), lengths * np.log(1e-30))
    counts = hmm._expected(model, tokens, lengths)
    assert np.isclose(counts[-1], 700 * np.log(1e-30)) and np.isclose(counts[8:14].sum(), 700)


def test_expected_counts_by_enumeration():
    import itertools

    model = small_model()
    x = np.array([0, 3, 3, 5])
    move, emit, start, total = np.zeros((3, 3)), np.zeros((3, 6)), np.zeros(3), 0.0
    for path in itertools.product(range(3), repeat=4):
        p = model.start[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:])]) * np.prod([model.emit[s, t] for s, t in zip(path, x)])
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for s, t in zip(path, x):
            emit[s, t] += p
    got = hmm.expected_counts(model, x, np.array([4]))
    assert np.allclose(got, np.concatenate([start, np.zeros(3), move.ravel(), emit.ravel()]) / total)


def test_training_raises_the_likelihood():
    truth = small_model(2, 5, 4)
    truth.move = np.array([[.95, .05], [.1, .9]])
    rng = np.random.default_rng(0)
    tokens = []
    for _ in range(60):
        s = 0
        for _ in range(30):
            s = rng.choice(2, p=truth.move[s])
            tokens.append(rng.choice(5, p=truth.emit[s]))
    tokens, lengths = np.array(tokens), np.full(60, 30)
    model, last = hmm.Model.first(2, np.bincount(tokens).astype(float)), -np.inf
    for _ in range(8):
        now = hmm.log_likelihoods(model, tokens, lengths).sum()
        assert now > last - 0.05
        last, model = now, hmm.Model.from_counts(hmm.expected_counts(model, tokens, lengths), 2)


def test_neighbour_counts_and_the_states_they_start(spark):
    """Counts by hand, and pairs of a two-state chain that the factoring explains."""
    data = [(1, "a b a", None, None, None), (2, None, None, None, None), (10, "b", None, None, None), (3, "b b", None, None, None)]
    docs = hmm.hold_out(H.documents(spark, data))
    held = {r.doc_id for r in docs.where("hmm_held_out").collect()}
    got = hmm.neighbour_counts(hmm.blocks(docs, "hmm_held_out"), 4)
    want = np.zeros((17, 17))
    for d, text, *_ in data:
        words, _ = word_hashes(pa.array([text or ""]))
        seq = [*hmm.class_of(words, 4).tolist(), 16]
        for x, y in zip(seq, seq[1:]):
            want[x, y] += d not in held
    assert (got == want).all() and got.sum() > 0

    rng = np.random.default_rng(3)
    move, emit = np.array([[0.9, 0.1], [0.2, 0.8]]), np.zeros((2, 17))
    emit[0, :8], emit[1, 8:] = rng.dirichlet(np.ones(8) * 5), rng.dirichlet(np.ones(9) * 5)
    held_share = np.array([2 / 3, 1 / 3])
    pairs = 1e6 * emit.T @ (held_share[:, None] * move) @ emit
    model = hmm.Model.from_pairs(pairs, 2, pairs.sum(axis=0))
    told = model.emit.T @ (model.start[:, None] * model.move) @ model.emit  # emissions may overlap, so only the pairs are unique
    assert np.allclose(told, pairs / pairs.sum(), atol=1e-3)


def test_no_training_text_and_settled_passes(spark):
    empty = hmm.blocks(hmm.hold_out(H.empty_documents(spark)), "hmm_held_out")
    model = hmm.train(empty, np.zeros(17), states=2, bits=4)
    assert np.isfinite(model.emit).all() and np.allclose(model.emit.sum(axis=1), 1)
    store = hmm.blocks(hmm.hold_out(H.documents(spark)), "hmm_held_out")
    counts = np.ones(17)
    once, eager = (hmm.train(store, counts, states=2, bits=4, passes=n, settled=s) for n, s in ((2, 0.0), (9, np.inf)))
    assert np.allclose(once.emit, eager.emit)  # the second pass gains less than the bound
    log = [hmm.baum_welch_pass(store, m, 4)[-1] for m in (hmm.train(store, counts, states=2, bits=4, passes=n, settled=0.0) for n in (1, 4))]
    assert log[1] >= log[0]


def test_scores_against_counts_by_hand(spark):
    data = H.rows() + [(3, "repeated id", None, None, None), (None, "no id here", None, None, None)]
    out = hmm.score(hmm.hold_out(H.documents(spark, data)), "hmm_held_out", states=3, bits=6, passes=1).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter(w for d, t, *_ in data if not held(d) for w in [*H.words_of(t), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t, *_ in data:
        words = [*H.words_of(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want[d, held(d), len(words), sum(count[w] > 0 for w in words), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert hmm.score(hmm.hold_out(H.empty_documents(spark)), "hmm_held_out", states=2, bits=4, passes=1).count() == 0


def test_words_sum_to_one():
    """Known words and one unknown share of every class fill the class."""
    c, n_class, v_class = np.array([3.0, 1.0]), 4.0, 2.0
    share = np.append(c + 0.1, 0.1) / (n_class + 0.1 * (v_class + 1))
    assert math.isclose(share.sum(), 1.0)


def test_held_out_score_beats_the_base(spark):
    from linkweave.llm.queries import op1_lm_score

    rows = [r for r in op1_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# ---- byte network

def test_byte_network_gradients():
    net = langid.ByteGRU(["a", "b", "c"], 4)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(x, y)
    for k, p in net.params.items():
        i = tuple(rng.integers(0, s) for s in p.shape)
        i = (int(x[2, 1]), i[1]) if k[0] == "x" else i
        old, e = p[i], 1e-4
        p[i] = old + e
        up = net.gradients(x, y)[0]
        p[i] = old - e
        down = net.gradients(x, y)[0]
        p[i] = old
        assert math.isclose((up - down) / (2 * e), grads[k][i], rel_tol=2e-2, abs_tol=2e-5)


def test_document_probabilities_pool_whole_texts():
    from linkweave.llm.words import buffers

    net = langid.ByteGRU(["a", "b"], 4)
    texts = ["", "abc", "x" * 127, "y" * 128, "z" * 129, "é" * 400]
    got = net.document_probabilities(*buffers(pa.array(texts)))
    for t, p in zip(texts, got):
        raw = t.encode()
        parts = [raw[i:i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
        want = sum((net.position_probabilities(np.frombuffer(q, np.uint8)[:, None]).sum(axis=(0, 1)) for q in parts), np.zeros(2))
        assert np.allclose(p, want / max(1, len(raw)), atol=1e-5)


def test_language_of_held_out_documents(spark):
    from linkweave.llm.queries import op9_language_id

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op9_language_id(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [d for d in got if got[d].held_out]
    assert set(got) == set(truth) and held == [d for d in got if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(spark):
    docs = H.documents(spark)
    net = langid.train(docs)
    assert net.languages == ["de", "en"]
    out = langid.predict(docs, net).collect()
    lettered = {r[0]: any(c.isalpha() for c in r[1] or "") for r in H.rows()}
    assert len(out) == len(lettered) and all((r.lang_pred == "und") == (not lettered[r.doc_id]) for r in out)
    kept = langid.accepted(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, ok in lettered.items() if ok}
    assert langid.train(H.empty_documents(spark)) is None
    assert langid.predict(H.empty_documents(spark), net).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


# ---- block labeller

def test_leaves():
    page = ('<html><head><title>x</title></head><body><script>if(a<b){"</p>"}</script><nav><a href="x">A</a></nav><article class="Big post">'
            '<h1>T &amp; U</h1><p><b>Bo<i>ld</i> a.<br>x<p>Two&nbsp;w<!-- c --> z</article>tail')
    assert html_extract.leaves(page) == [
        (("html", "body", "nav"), "A"), (("html", "body", "article", ".big", ".post", "h1"), "T & U"),
        (("html", "body", "article", ".big", ".post", "p"), "Bold a. x"),
        (("html", "body", "article", ".big", ".post", "p"), "Two w z"), (("html", "body"), "tail")]
    for odd in ("", "plain", "<", "<p", "<!--", "<script>", "</p></p>", "<p>a</div>b", "&#x41;&bogus;"):
        html_extract.leaves(odd)


def test_block_network_gradients():
    net = html_extract.BlockLSTM(3)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(0)
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    x = rng.random((5, 3, html_extract.INPUT)) * mask[:, :, None]
    y = (rng.random((5, 3)) > 0.5) * mask
    _, grads = net.gradients(x, mask, y)
    for k, p in net.params.items():
        i = tuple(rng.integers(0, s) for s in p.shape)
        old, e = p[i], 1e-4
        p[i] = old + e
        up = net.gradients(x, mask, y)[0]
        p[i] = old - e
        down = net.gradients(x, mask, y)[0]
        p[i] = old
        assert math.isclose((up - down) / (2 * e), grads[k][i], rel_tol=2e-2, abs_tol=2e-5)


def test_extraction_of_unseen_pages(spark):
    train = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    net = html_extract.train(train, 200)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, None, "<nav><ul><li>Menu</li></ul></nav>"), (-4, "u", "<"),
                                 (None, "u", "<html><body><article><h1>Head</h1><p>A long story about a harbour. It goes on and on.</p></article></body></html>")],
                                "page_id long, url string, html string")
    out = {r.page_id: r for r in html_extract.extract(pages.unionByName(odd).selectExpr("*", "1 AS text", "2 AS blocks"), net).collect()}
    right = 0
    for r in pages.collect():
        want = " ".join(t for path, t in html_extract.leaves(r.html) if html_extract.teacher(path))
        right += out[r.page_id].text == want and out[r.page_id].n_chars == len(want)
    assert right / pages.count() > 0.97
    assert [out[i].text for i in (-1, -2, -3)] == [""] * 3 and -4 in out and out[-1].n_chars == 0 and None in out
    assert html_extract.extract(pages.limit(0), net).count() == 0
    labelled = html_extract.blocks(pages.limit(3), net).collect()
    assert all(" ".join(b.text for b in r.blocks if b.main) == out[r.page_id].text for r in labelled)
    html_extract.train(pages.limit(0))


# ---- mixing

def test_raked_weights_meet_the_targets(spark):
    docs = H.documents(spark)
    targets = spark.createDataFrame(
        [("source", "s0", 3.0), ("source", "s1", 1.0), ("source", "s2", 1.0), ("source", "unknown", 1.0), ("source", "nowhere", 9.0),
         ("lang", "de", 1.0), ("lang", "en", 2.0), ("lang", "unknown", 1.0),
         ("topic", "brief", 2.0), ("topic", "standard", 1.0), ("topic", "long", 1.0)], "dimension string, category string, share double")
    marked = mixing.with_cells(docs)
    cells = marked.groupBy(*[marked[f"mix_{d}"].alias(d) for d in mixing.DIMENSIONS]).agg({"mix_tokens": "sum"}).withColumnRenamed("sum(mix_tokens)", "tokens")
    fitted = mixing.rake(cells, targets, rounds=60).collect()
    assert math.isclose(sum(r.weight for r in fitted), 1, rel_tol=1e-9)
    held = lambda d, c: sum(r.weight for r in fitted if r[d] == c)
    assert math.isclose(held("topic", "brief"), 0.5, rel_tol=1e-6)
    for d, c in (("source", "s0"), ("lang", "en")):
        assert math.isclose(held(d, c), 0.5, rel_tol=0.2)


def test_mix_odd_rows_and_draw(spark):
    docs = H.documents(spark)
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == len(H.rows()) and set(docs.columns) - {"mix_rate"} <= set(out.columns)
    for r in rows:
        n = len(H.words_of(r.text)) if r.text else 0
        assert r.mix_tokens == n and 0 <= r.mix_rate <= 1 and (n > 0 or not r.mix_kept)
        import hashlib
        u = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32
        assert r.mix_kept == (u < r.mix_rate)
    assert max(r.mix_rate for r in rows) == 1.0
    assert mixing.mix(H.empty_documents(spark)).count() == 0
    one = mixing.mix(H.documents(spark, [(None, "a", None, None, None), (1, "b c", "en", "x", None)])).collect()
    assert {r.mix_source for r in one} == {"unknown", "x"}


# ---- token output

def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for trial in range(40):
        lengths = rng.integers(0, 4000, rng.integers(1, 6))
        n = int(lengths.sum())
        v = (rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1) >> rng.integers(0, 64, n).astype(np.uint64)
        v = v >> np.uint64(50) if trial % 3 == 0 else np.where(rng.random(n) < 0.9, 0, v).astype(np.uint64) if trial % 3 == 1 else v
        words, per_block, wide, n_wide = simple8b.encode(v, lengths)
        assert (simple8b.decode(words, per_block, lengths, wide, n_wide) == v).all()
        assert (wide >> np.uint64(60) > 0).all()
    words, per_block, wide, _ = simple8b.encode(np.zeros(1024, np.uint64), np.array([1024]))
    assert len(words) == 9 and per_block.tolist() == [9] and not len(wide)  # 120 zeros a word


def test_pretokens_equal_the_library():
    import random

    from tokenizers import Tokenizer

    rnd = random.Random(2)
    tok = Tokenizer.from_file(tokenizer_file())
    alphabet = [*"abcT's've'll ''  \n\n\t é÷×ñ0129.,!?-'re'd'm", " ", "漢", "\r", "\x1c", "<|endoftext|>", " \n", " "]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(3000)] + H.texts() + ["'", "'s", " 's", "x's", "\n's", "  "]
    ids, n = token_output.encode_column(pa.array(texts), tokenizer_file(), 0)
    at = np.cumsum(n) - n
    for t, a, k in zip(texts, at, n):
        assert ids[a:a + k].tolist() == tok.encode(t or "", add_special_tokens=False).ids + [0]


def test_token_records_round_trip(spark, tmp_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    data = H.rows() + [(3, "same id again", None, None, None)]
    token_output.write_tokens(H.documents(spark, data), f"{tmp_dir}/tokens", tokenizer_file())
    records = spark.read.parquet(f"{tmp_dir}/tokens")
    want, start = [], 0
    for d, t, *_ in sorted(data, key=lambda r: (r[0], r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.digests(records).collect())) == sorted(want)
    ids = {(r.doc_id, r.n_tokens): r.ids for r in token_output.read_tokens(records).collect()}
    assert all(zlib.crc32(np.array(ids[d, n], "<u4").tobytes()) == c for d, _, n, c in want)
    token_output.write_tokens(H.empty_documents(spark), f"{tmp_dir}/none", tokenizer_file())
    assert token_output.digests(spark.read.parquet(f"{tmp_dir}/none")).count() == 0


def test_piece_table_makes_room(monkeypatch):
    texts = pa.array([" ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}{'x' * (i % 3)} don't {i * j}" for j in range(30)) for i in range(40)])
    want, n_want = token_output.encode_column(texts, tokenizer_file(), 0)
    for known, slots in ((60, 256), (3, 16), (100_000, 1 << 18)):
        monkeypatch.setattr(token_output, "KNOWN_PIECES", known)
        monkeypatch.setattr(token_output, "SLOTS", slots)
        monkeypatch.setattr(token_output, "_TABLES", {})
        parts = [token_output.encode_column(texts[i:i + 4], tokenizer_file(), 0) for i in range(0, 40, 4)]
        assert np.array_equal(np.concatenate([p[0] for p in parts]), want) and np.array_equal(np.concatenate([p[1] for p in parts]), n_want)
        table = token_output.piece_table(tokenizer_file())
        assert len(table.count) <= max(known, 500)
