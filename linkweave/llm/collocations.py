"""Phrase collocations: n-grams of every language counted by FM-indexes over word ids, one index per shard.

A text is lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, a piece into words
``[^\\x20\\x09]+``. Phrases never leave a piece; everything is counted per language (null: ``und``).

* **Shard.** About ``SHARD_BYTES`` of text become one circular sequence of word ids (a word's key holds its
  language), with symbol 0 between pieces. Two Burrows-Wheeler transforms, of the sequence and of its
  reverse, both sorted by the first ``DEPTH`` words, make the index. A phrase is a pair of intervals of
  equal size: ``extend`` takes the symbols in one interval as the extensions to that side, with counts; the
  LF mapping gives the interval of each in the same index, the number of smaller symbols in the range the one
  in the other index. All phrases of a level are extended at once.
* **Levels.** A phrase is as frequent as its rarest part at most, so a level keeps only what can reach
  ``least``: words first; then pairs of frequent words (extension to the right); then, from
  every frequent pair as the middle, triples by extension to the left and quadruples by extension to
  the right, all of whose pairs are frequent. Tasks know frequent phrases through a bit filter of fixed size (16 MB
  however many there are); what passes it by chance is sorted out by the exact sums. Where it fills up on
  a very large corpus, more rows are shuffled, and the result stays the same.
* **Sums.** Spark sums the counts of all shards by the 64-bit key of the phrase; only sums of ``least`` or more
  are looked up as text again, where they stand in the texts. All later steps are joins and grouped minima on these.

Null or empty text: no words. Texts of any length are read whole. Repeated rows count each. Ties: the
smallest cut, then higher count, then the phrase in byte order. An empty table gives an empty result. ``doc_id``
and other columns are ignored. Sums are 64-bit, products decimal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.tables import FILTER_BITS, id_filter, passes
from linkweave.llm.words import PIECE, buffers, mix64, pieces, seeds, signed, span_hashes
from linkweave.session import materialize, release_scratch, scratch_tables

DEPTH = 4
SHARD_BYTES = 4 * PIECE
SPELT = 1 << 15  # phrases in a batch of the spelling
_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_ADD, _TIMES = seeds(DEPTH, 121), seeds(DEPTH, 122)


def place(keys: np.ndarray) -> np.ndarray:
    return (keys & _U((1 << FILTER_BITS) - 1)).astype(np.int64)


def phrase_keys(parts: list[np.ndarray]) -> np.ndarray:
    """Key of the phrase whose words have the keys ``parts``, column by column."""
    total = np.full(len(parts[0]), len(parts), _U)
    for i, x in enumerate(parts):
        total += mix64(x + _ADD[i]) * _TIMES[i]
    return mix64(total)


class Words:
    """The words of a batch of texts in order: key (with its language), position in the bytes, and where a piece begins."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.raw, offsets = buffers(texts)
        ends_word = _BREAK[self.raw] | _BLANK[self.raw]
        edge = np.ones(len(self.raw) + 2, bool)
        edge[1:-1] = ends_word
        cut = np.zeros(len(self.raw) + 1, bool)
        cut[offsets] = True
        word = ~ends_word
        self.starts = np.flatnonzero(word & (edge[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(word & (edge[2:] | cut[1:])) + 1
        doc = np.searchsorted(offsets, self.starts, side="right") - 1
        broken = np.zeros(len(self.raw) + 1, np.int32 if len(self.raw) < 1 << 31 else np.int64)
        np.cumsum(_BREAK[self.raw], dtype=broken.dtype, out=broken[1:])
        self.opens = np.ones(len(doc), bool)
        self.opens[1:] = (doc[1:] != doc[:-1]) | (broken[self.starts[1:]] != broken[self.ends[:-1]])
        self.langs, self.lang = np.unique(np.array(langs.fill_null("und").to_pylist(), object), return_inverse=True)
        lang_raw, lang_at = buffers(pa.array(self.langs.tolist(), pa.string()))
        own = np.array([span_hashes(lang_raw, lang_at[i:i + 1], lang_at[i + 1:i + 2], lower=False)[0] for i in range(len(self.langs))], _U)
        own = mix64(own + _U(0x1A46))  # the name of a language may be a word, too
        self.lang_keys = mix64(own + _U(1))
        self.word_lang = self.lang[doc]
        self.keys = mix64(span_hashes(self.raw, self.starts, self.ends) + own[self.word_lang])

    def text(self, i: int) -> str:
        return self.raw[self.starts[i]:self.ends[i]].tobytes().decode().translate(_LOWER)

    def between(self, first: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words from the words ``first`` on, joined by single spaces."""
        plain = np.ones(len(first), bool)  # one space after every word but the last
        for i in range(1, size):
            gap = self.ends[first + i - 1]
            plain &= (self.starts[first + i] == gap + 1) & (self.raw[np.minimum(gap, len(self.raw) - 1)] == 32)
        lo = self.starts[first]
        length = self.ends[first + size - 1] - lo
        ends = np.cumsum(length)
        data = _SMALL[self.raw[np.repeat(lo - (ends - length), length) + np.arange(length.sum())]]
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        out = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
        if plain.all():
            return out
        rest = [" ".join(self.text(w + i) for i in range(size)) for w in first[~plain].tolist()]
        return pc.replace_with_mask(out, pa.array(~plain), pa.array(rest, pa.string()))


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_LOWER = {i: i + 32 for i in range(65, 91)}


def transform(seq: np.ndarray, radix: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a circular sequence in the order of the next four symbols, and its LF mapping."""
    key = seq * np.int64(radix)
    key += np.roll(seq, -1)
    two = np.unique(key, return_inverse=True)[1]
    np.multiply(two, two.max() + 1, out=key)
    key += np.roll(two, -2)
    del two
    order = np.argsort(key)
    del key
    order -= 1
    bwt = seq[order]
    del order
    lf = np.empty(len(seq), np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(len(seq), dtype=np.int32)
    return bwt, lf


def extend(side: tuple[np.ndarray, np.ndarray], radix: int, low: np.ndarray, size: np.ndarray,
           other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All extensions of phrases by one word to one side.

    ``low`` and ``other`` are the starts of the phrases' intervals in the index of that side and in the other one.
    Returns phrase, word, count and the starts of both intervals of every extension.
    """
    bwt, lf = side
    row = np.repeat(np.arange(len(low), dtype=np.int32), size)
    at = np.arange(len(row), dtype=np.int32) + np.repeat((low - (np.cumsum(size) - size)).astype(np.int32), size)
    symbols = row * np.int64(radix)
    symbols += bwt[at]
    del row
    found, first, n = np.unique(symbols, return_index=True, return_counts=True)
    del symbols
    row, word = found // radix, found % radix
    before = np.cumsum(n) - n
    smaller = before - before[np.searchsorted(row, row, side="left")]
    keep = word > 0
    row = row[keep]
    return row, word[keep], n[keep], lf[at[first[keep]]], other[row] + smaller[keep]


class Index:
    """Bidirectional FM-index of the words that may be part of a frequent phrase."""

    def __init__(self, words: Words, known: np.ndarray):
        at = np.flatnonzero(passes(known, place(words.keys)))
        self.keys, first, ids = np.unique(words.keys[at], return_index=True, return_inverse=True)
        self.first = at[first]  # where each word stands first
        n = len(self.keys)
        # symbol 0 wherever a piece begins or words have been left out
        run = np.cumsum(words.opens)[at]
        opens = np.ones(len(at), bool)
        opens[1:] = (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1])
        # a batch of rows has less than 2 ** 31 bytes, so ids and places of a shard take 32 bits
        seq = np.zeros(len(at) + int(opens.sum()) + (len(at) == 0), np.int32)
        seq[np.arange(len(at)) + np.cumsum(opens)] = ids + 1
        del at, first, ids, run, opens
        self.radix = n + 1
        self.left, self.right = transform(seq, self.radix), transform(seq[::-1], self.radix)
        counts = np.bincount(seq, minlength=n + 1)
        self.low, self.count = (np.cumsum(counts) - counts)[1:], counts[1:]

    def levels(self, known: np.ndarray, depth: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """(word ids column by column, key, count) of the phrases of two words, then of three and of four whose pairs ``known`` holds."""
        key = lambda *cols: phrase_keys([self.keys[c] for c in cols])
        b, c, n, right, left = extend(self.right, self.radix, self.low, self.count, self.low)
        c = c - 1
        pair = key(b, c)
        yield [b, c], pair, n
        if depth < 3:
            return
        frequent = passes(known, place(pair))
        b, c, n, right, left = b[frequent], c[frequent], n[frequent], right[frequent], left[frequent]
        row, a, n, left, right = extend(self.left, self.radix, left, n, right)
        a, b, c = a - 1, b[row], c[row]
        frequent = passes(known, place(key(a, b)))
        a, b, c, n, left, right = (x[frequent] for x in (a, b, c, n, left, right))
        yield [a, b, c], key(a, b, c), n
        row, d, n, right, left = extend(self.right, self.radix, right, n, left)
        d, a, b, c = d - 1, a[row], b[row], c[row]
        frequent = passes(known, place(key(c, d)))
        a, b, c, d, n = (x[frequent] for x in (a, b, c, d, n))
        yield [a, b, c, d], key(a, b, c, d), n


def standing(words: Words, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, keys, index of the first word) of the phrases in the texts that ``known`` holds, each key once.

    Words are looked up where they stand, so nothing is sorted but what ``known`` holds. A phrase is listed if all
    its parts are, as the parts of a frequent phrase are frequent.
    """
    n = len(words.keys)
    at = np.arange(n)
    held = np.zeros(n + DEPTH, bool)  # whether the phrase of the size before, from this word on, is known
    held[:n] = True
    for size in range(1, DEPTH + 1):
        if size > 1:
            at = at[held[at + 1]]
            at = at[~words.opens[at + size - 1]]
        key = words.keys[at] if size == 1 else phrase_keys([words.keys[at + i] for i in range(size)])
        found = passes(known, place(key))
        at, key = at[found], key[found]
        held[:] = False
        held[at] = True
        key, first = np.unique(key, return_index=True)
        yield size, key, at[first]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for b in pieces(batches, SHARD_BYTES):
        yield Words(b.column("text"), b.column("lang"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def _sums(counted: DataFrame, least: int, name: str) -> DataFrame:
    return materialize(counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), name)


def _pack(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n.astype(np.int64))], ["key", "n"])


def _filter(*known: DataFrame):
    keys = known[0].select("key")
    for k in known[1:]:
        keys = keys.union(k.select("key"))
    return keys.sparkSession.sparkContext.broadcast(
        id_filter(keys.select(F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("place"))))


def frequent_phrases(docs: DataFrame, least: int = 30) -> DataFrame:
    """``(lang, size, phrase, n)`` of all phrases of 1 to 4 words with ``n >= least`` occurrences in a language.

    A row of size 0 (empty phrase) holds the number of all words of a language.
    """
    spark, rows = docs.sparkSession, _rows(docs)
    before = set(scratch_tables(spark))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _batches(batches):
            yield _pack(words.lang_keys, np.bincount(words.word_lang, minlength=len(words.langs)))
            yield _pack(*np.unique(words.keys, return_counts=True))

    single = _sums(rows.mapInArrow(count_words, "key bigint, n bigint"), least, "phrases-1")
    known_words = _filter(single)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _batches(batches):
            for _, key, n in Index(words, known_words.value).levels(known_words.value, 2):
                yield _pack(key, n)

    pairs = _sums(rows.mapInArrow(count_pairs, "key bigint, n bigint"), least, "phrases-2")
    known_pairs = _filter(single, pairs)

    def count_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _batches(batches):
            for ids, key, n in Index(words, known_pairs.value).levels(known_pairs.value, DEPTH):
                if len(ids) > 2:
                    yield _pack(key, n)

    longer = _sums(rows.mapInArrow(count_longer, "key bigint, n bigint"), least, "phrases-4")
    known = _filter(single, pairs, longer)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(size: int, lang: np.ndarray, phrase: pa.Array, key: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(np.full(len(key), size, np.int32)), phrase, pa.array(signed(key))],
                ["lang", "size", "phrase", "key"])

        for words in _batches(batches):
            yield pack(0, words.langs, pa.array([""] * len(words.langs), pa.string()), words.lang_keys)
            for size, key, at in standing(words, known.value):
                for i in range(0, len(key), SPELT):
                    some = at[i:i + SPELT]
                    yield pack(size, words.langs[words.word_lang[some]], words.between(some, size), key[i:i + SPELT])

    spelt = rows.mapInArrow(spell, "lang string, size int, phrase string, key bigint").distinct()
    sums = single.union(pairs).union(longer)
    out = materialize(spelt.join(sums, "key").select("lang", "size", "phrase", "n"), "phrases")
    for shared in (known_words, known_pairs, known):
        shared.destroy()
    release_scratch(spark, [p for p in scratch_tables(spark) if p not in before][:-1])
    return out


def extensions(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, left_n, right_n)``: counts of the most frequent phrases longer by one word to the left and to the right."""
    longer = phrases.where("size >= 2").select(
        "lang", "n", F.expr("substr(phrase, length(substring_index(phrase, ' ', 1)) + 2)").alias("rest"),
        F.expr("substring_index(phrase, ' ', size - 1)").alias("head"))
    sides = longer.select("lang", F.inline(F.array(
        F.struct(F.col("rest").alias("phrase"), F.col("n").alias("l"), F.lit(None).cast("long").alias("r")),
        F.struct(F.col("head").alias("phrase"), F.lit(None).cast("long").alias("l"), F.col("n").alias("r")))))
    return sides.groupBy("lang", "phrase").agg(F.max("l").alias("left_n"), F.max("r").alias("right_n"))


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two to four words of each language.

    A phrase's score is that of its weakest cut, ``floor(2000000 a / (l + r))``. A phrase goes when an extension (and so
    any longer phrase around it) has ``covered`` per cent of its occurrences.
    """
    phrases = frequent_phrases(docs, least)
    own = phrases.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    cuts = (own.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("rest", F.expr("substr(phrase, length(head) + 2)")))
    part = phrases.where("size BETWEEN 1 AND 3")
    heads = part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = (cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
               .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))
    most = F.greatest("left_n", "right_n")
    inside = F.coalesce(F.expr("CAST(100 AS DECIMAL(3,0))") * most.cast("decimal(20,0)")
                        >= F.lit(covered).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)"), F.lit(False))
    kept = weakest.join(extensions(phrases), ["lang", "phrase"], "left").where(~inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top))
    words = phrases.where("size = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
