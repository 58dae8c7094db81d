"""Token alignment, phrase collocations and url filter against plain versions of their rules."""
import functools
import hashlib
import re
from collections import Counter, defaultdict

import helpers as H
import numpy as np
import pyarrow as pa
import pytest

from linkweave.llm import align, collocations, url_filter
from linkweave.llm.queries import piece_file, tokenizer_file

# ---- alignment


@pytest.fixture(scope="module")
def spans():
    return align.Spans(tokenizer_file(), piece_file())


ODD = ["a", " ", "  ", " a", "a ", "a  b", "a \n b", "x\n  y", "x \ny", "tab\t\tz", "a\u00a0 b", "a\u3000 b", "\u2003 b", "no\u2581mark", "\u2581",
       "don't we'll I'd 'S", "<|endoftext|> <s> </s> <unk> <0x41>", "漢字 かな 混じり", "हिन्दी में लिखा", "e\u0301 é", "🙂 🙂🙂 x", "a\x00b", "\r\n\r\n x",
       "1234567890 3.14", "x" * 3000, " ".join("αβγ" for _ in range(500)), "ñ ß ü. Ça va — oui", "a\u0085 b", "\ufeff bom", "a" + " " * 40 + "b"]


@functools.cache
def vocabulary(path):
    from tokenizers import Tokenizer

    return align._byte_letters(), {i: e for e, i in Tokenizer.from_file(path).get_vocab().items()}


def token_bytes(spans, text):
    """Ids and bytes of both tokenizers, from the libraries on the whole text."""
    a = spans.tokenizer.encode(" " + text, add_special_tokens=False).ids
    letters, entries = vocabulary(tokenizer_file())
    a_bytes = [bytes(letters[c] for c in entries[i]) for i in a]
    b = spans.model.encode(text)
    names = [spans.model.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("\u2581", " ").encode() for n in names]
    return a, a_bytes, b, b_bytes


def by_hand(spans, text):
    """(n_a, n_b, groups, linked pairs in order)."""
    if not text:
        return 0, 0, "", []
    a, a_bytes, b, b_bytes = token_bytes(spans, text)
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return 0, 0, "", []
    ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
    groups, links, i, j, part = [], [], 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if j == len(b) or i < len(a) and ends_a[i] <= ends_b[j]:
            part[0].append(a[i])
            i += 1
        else:
            part[1].append(b[j])
            j += 1
        if i and j and ends_a[i - 1] == ends_b[j - 1]:
            groups.append("|".join(",".join(map(str, p)) for p in part))
            part = ([], [])
    start_a, start_b = ends_a - [len(x) for x in a_bytes], ends_b - [len(x) for x in b_bytes]
    j = 0
    for i in range(len(a)):
        while ends_b[j] <= start_a[i]:
            j += 1
        k = j
        while k < len(b) and start_b[k] < ends_a[i]:
            links.append((a[i], b[k]))
            k += 1
    return len(a), len(b), ";".join(groups), links


def test_gallop_equals_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n_short = rng.integers(0, 30, 8)
        n_long = n_short + rng.integers(0, 90, 8) * (n_short > 0)
        short = [np.sort(rng.choice(400, k, replace=False)) for k in n_short]
        long = [np.sort(rng.choice(400, k, replace=False)) for k in n_long]
        want = [np.searchsorted(y, x) + at for x, y, at in zip(short, long, np.cumsum(n_long) - n_long)]
        assert np.array_equal(align.gallop(np.concatenate(short), n_short, np.concatenate(long), n_long), np.concatenate(want))


def test_gallop_without_elements():
    none = np.zeros(0, np.int64)
    assert len(align.gallop(none, none, none, none)) == 0
    assert len(align.gallop(none, np.zeros(3, np.int64), none, np.zeros(3, np.int64))) == 0


def test_spans_give_the_tokens_of_whole_texts(spans):
    import duckdb

    texts = ODD + H.texts() + [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    rng = np.random.default_rng(3)
    parts = ["a", "Word", " ", "  ", "\n", "\t", "\u00a0", "é", "漢", "\u2581", "'s", "12", "-", "\u3000", "\u2029", "ह", "."]
    texts += ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(1500)]
    block = align.Block(pa.array(texts, pa.string()), spans, digest=False)
    counts = Counter()
    for i, text in enumerate(texts):
        n_a, n_b, groups, links = by_hand(spans, text)
        assert (block.n_a[i], block.n_b[i], block.groups[i], block.n_links[i]) == (n_a, n_b, groups, len(links)), repr(text)
        assert block.n_groups[i] == (groups.count(";") + 1 if groups else 0)
        counts.update(set(links))
    assert {k: n for k, n in zip(block.keys.tolist(), block.found.tolist()) if n} == {a << 32 | b: n for (a, b), n in counts.items()}


def test_memory_of_spans_is_bounded(spans, monkeypatch):
    monkeypatch.setattr(align, "KNOWN", 50)
    own = align.Spans(tokenizer_file(), piece_file())
    texts = [f"some words and number {i} of {i % 7} {'x' * (i % 5)}" for i in range(300)]
    for lo in range(0, 300, 10):
        block = align.Block(pa.array(texts[lo:lo + 10]), own, digest=False)
        for i in range(10):
            assert block.groups[i] == by_hand(spans, texts[lo + i])[2]
    assert len(own.texts) < 200


def test_alignment_of_a_table(spark, spans):
    data = H.rows() + [(5000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "null id", None, None, None)] * 2 + [(0, "again", "en", "s", 1)]
    docs = H.documents(spark, data)
    got = align.align(docs, tokenizer_file(), piece_file()).collect()
    made = [(r[0], *by_hand(spans, r[1])) for r in data]
    count = Counter(p for m in made for p in set(m[4]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = [(d, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(count[p] == most[p[0]] for p in links),
             sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "") for d, n_a, n_b, groups, links in made]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    texts = align.align(docs, tokenizer_file(), piece_file(), digest=False).select("groups").collect()
    assert sorted(r.groups for r in texts) == sorted(m[3] for m in made)


def test_alignment_of_an_empty_table(spark):
    assert align.align(H.empty_documents(spark), tokenizer_file(), piece_file()).collect() == []


# ---- collocations

def phrases_by_hand(data, least):
    total, f = Counter(), Counter()
    for text, lang in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", H.lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return total, {p: n for p, n in f.items() if n >= least}


def collocations_by_hand(data, least, covered, top):
    total, f = phrases_by_hand(data, least)
    best = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            inside = any(x == lang and len(q) > len(p) and 100 * n >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for (x, q), n in f.items())
            if not inside:
                best[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
                  for lang, rows in best.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def phrase_data():
    rng = np.random.default_rng(5)
    words = ["the", "of", "en", "de", "New", "new", "york", "city", "a", "été", "漢", "x-y", "Hall", "1,5", "it's"]
    out = [(t, ("en", "de", None)[i % 3]) for i, t in enumerate(H.texts())]
    for i in range(120):
        t = " ".join(rng.choice(words, rng.integers(0, 60)))
        t = t.replace("the of", "the\tof;").replace("york a", "york. a") + (" new york city hall" * int(rng.integers(0, 3)))
        out.append((t, ("en", "fr", None, "und")[i % 4]))
    return out + [("a a a a a a, a a\na", "aa")] * 9 + [("solo", "one"), ("", "none"), (None, "none")]


@pytest.mark.parametrize("least,top", [(3, 2000), (8, 5), (30, 2000)])
def test_collocations_equal_counts_by_hand(spark, least, top):
    data = phrase_data()
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(data)], "doc_id long, text string, lang string").selectExpr(
        "*", *[f"CAST(NULL AS STRING) AS `{c}`" for c in ("key", "n", "phrase", "rank", "score", "size", "a", "l")]).repartition(5)
    got = [tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect()]
    assert sorted(got) == collocations_by_hand(data, least, 80, top)


def test_known_phrases_are_spelt_where_they_stand():
    texts = pa.array(["Big\tred  dog, big red dog cat", "big red. Dog", None, ""])
    words = collocations.Words(texts, pa.array(["x"] * 4))
    known = np.zeros(1 << (collocations.FILTER_BITS - 6), np.uint64)
    index = collocations.Index(words, ~known)
    keys = [index.keys, *(key for _, key, n in index.levels(~known, 4))]
    for key in np.concatenate(keys):
        known[collocations.place(key) >> 6] |= np.uint64(1) << np.uint64(collocations.place(key) & 63)
    got = {(size, phrase): int(k) for size, key, at in collocations.standing(words, known)
           for k, phrase in zip(key, words.between(at, size).to_pylist())}
    assert set(got) == {(1, "big"), (1, "red"), (1, "dog"), (1, "cat"), (2, "big red"), (2, "red dog"), (2, "dog cat"),
                        (3, "big red dog"), (3, "red dog cat"), (4, "big red dog cat")}
    assert set(got.values()) == {int(k) for k in np.concatenate(keys)}


def test_phrases_over_many_shards(spark, monkeypatch):
    data = phrase_data()
    total, f = phrases_by_hand(data, 4)
    docs = spark.createDataFrame([(t, x) for t, x in data], "text string, lang string").repartition(7)
    rows = collocations.frequent_phrases(docs, 4).collect()
    assert {(r.lang, r.phrase): r.n for r in rows if r.size} == {(lang, " ".join(p)): n for (lang, p), n in f.items()}
    assert {r.lang: r.n for r in rows if not r.size} == {k: n for k, n in total.items() if n >= 4}


def test_intervals_against_plain_counts():
    texts = pa.array([t for t, _ in phrase_data()], pa.string())
    words = collocations.Words(texts, pa.array(["x"] * len(texts)))
    everything = np.full(1 << (collocations.FILTER_BITS - 6), ~np.uint64(0))
    index = collocations.Index(words, everything)
    total, f = phrases_by_hand([(t, "x") for t, _ in phrase_data()], 1)
    names = [words.text(i) for i in index.first]
    for ids, _, n in index.levels(everything, 4):
        got = {tuple(names[c] for c in row): int(k) for row, k in zip(zip(*ids), n)}
        assert got == {p: k for (_, p), k in f.items() if len(p) == len(ids)}


def test_sums_beyond_64_bits(spark):
    big = 7 * 10**18
    rows = [("en", 0, "", big), ("en", 1, "p", big), ("en", 1, "q", big), ("en", 2, "p q", big - 10**12)]
    phrases = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    old = collocations.frequent_phrases
    collocations.frequent_phrases = lambda docs, least: phrases
    try:
        (r,) = collocations.collocations(phrases).collect()
    finally:
        collocations.frequent_phrases = old
    assert (r.a, r.l, r.r, r.score) == (big - 10**12, big, big, 2_000_000 * (big - 10**12) // (2 * big))


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(H.empty_documents(spark)).collect() == []


# ---- urls

def test_extensions_are_the_longer_phrases(spark):
    rows = [("x", 1, "b", 9), ("x", 2, "a b", 5), ("x", 2, "c b", 7), ("x", 2, "b d", 4), ("y", 2, "b e", 50)]
    got = {(r.lang, r.phrase): (r.left_n, r.right_n) for r in collocations.extensions(
        spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).collect()}
    assert got[("x", "b")] == (7, 4) and got[("y", "b")] == (None, 50)


def host_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return H.lower(host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def rule_by_hand(host, path, rules):
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def verdicts_by_hand(pages, rules, damping=0.85, rounds=6, limit=0.5):
    judged = [(*host_by_hand(u), html) for _, u, html in pages]
    ruled = [rule_by_hand(h, p, rules) for h, p, _ in judged]
    n, allowed, blocked, links = Counter(), Counter(), Counter(), Counter()
    for (h, _, html), (v, _) in zip(judged, ruled):
        if h:
            n[h] += 1
            allowed[h] += v == "allow"
            blocked[h] += v == "block"
            for to in {H.lower(x) for x in re.findall(r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s\\]+)""", html or "")} - {h}:
                links[h, to] += 1

    def walk(seed, edges):
        out = Counter()
        for (a, _), k in edges.items():
            out[a] += k
        hosts = set(n) | {x for e in edges for x in e}
        mass = {h: float(seed[h]) for h in hosts}
        for _ in range(rounds):
            came = defaultdict(float)
            for (a, b), k in edges.items():
                came[b] += mass[a] * k / out[a]
            mass = {h: (1 - damping) * seed[h] + damping * (came[h] + (0 if out[h] else mass[h])) for h in hosts}
        return mass

    trust, distrust = walk(allowed, links), walk(blocked, {(b, a): k for (a, b), k in links.items()})
    return [(d, h, p, rule, v or ("block" if h and round(distrust[h] - trust[h] - limit * n[h], 9) > 0 else "allow"))
            for (d, _, _), (h, p, _), (v, rule) in zip(pages, judged, ruled)]


PAGES = [(1, "https://WWW.Example.com/en/1?x=/y", None), (2, "http://example.com/en/2#a", ""), (3, "http://example.com/fr/", "<p>"),
         (4, "http://m.www.example.com/en/", None), (5, "http://Example.COM", None), (6, "http://com/", None), (7, "xcom/a", None), (None, None, None),
         (8, "http://shop.net/es/1", '<a href="http://farm.org/x">'), (9, "http://shop.net/fr/2", None), (10, "http://shop.net/en/3", None),
         (11, "http://half.net/es/1", None), (12, "http://half.net/en/2", None), (13, "http://farm.org/1", "<a href='//shop.net/'><a HREF = http://shop.net/fr>"),
         (14, "http://farm.org/1", "<a href=https://shop.net>"), (14, "http://farm.org/1", "<a href=https://shop.net>"), (15, "http://far.org/", '<a href="http://farm.org/">'),
         (16, "http://good.com/x", '<a href="http://fine.org/">'), (17, "http://fine.org/", '<a href="/en">in</a>'), (18, "ftp://a://b/c", None),
         (19, "://", None), (20, "http://net/es/", None), (21, "http://.net/fr/a", None), (22, "http://" + "a." * 3000 + "net/es/", None), (23, "http://x.org/es/", "href=//" * 500)]


def test_verdicts_by_hand(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", *[f"1 AS `{c}`" for c in ("host", "path", "rule", "verdict", "n", "src", "kind", "mass")]).repartition(4)
    for rules in (url_filter.RULES, url_filter.RULES + [("farm.org", "/1", "allow"), ("farm.org", "/1", "block")], [("shop.net", "/", "block")]):
        got = url_filter.judge(pages, url_filter.rule_table(spark, rules), rounds=6).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, verdicts_by_hand(PAGES, rules)))


def test_distrust_runs_against_the_links(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = {r.host: r for r in url_filter.judge(pages, url_filter.rule_table(spark, [("shop.net", "/", "block"), ("good.com", "/", "allow")]), rounds=12).collect()}
    assert rows["farm.org"].distrust > 0 and rows["far.org"].verdict == "block"  # it links to a host that links to a blocked one
    assert rows["fine.org"].trust > 0 and rows["fine.org"].verdict == "allow"


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark, [])).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).collect() == []
