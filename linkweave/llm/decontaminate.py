"""Benchmark decontamination: size-partitioned MinHash containment search, exact for short items, verified by exact containment.

Items (short) are searched inside documents (long). A MinHash of a whole long document
says nothing about a short item, so both sides are partitioned by size: an item with ``q``
shingles belongs to the class of the power of two ``u >= q`` (32 at least); for every class in
use a document is read as windows of ``2u`` shingles, one every ``u``, so any place where
an item stands lies whole in one window and the Jaccard similarity of the two is at least
about ``t q / 2u``, 0.2 or more, however long the document. ``PERMUTATIONS``
minima per window with bands of one row then meet with practical certainty
(0.8 ** 64 is 6e-7). Block minima of small classes combine to those of larger ones.

An item of up to ``EXACT`` shingles is found by its own shingles instead, without chance: a document
that holds ``m = ceil(t q)`` of them holds one of any ``q - m + 1``, so that many are its keys,
and every shingle of a document is looked up.

The items' keys are known to the tasks as a bit filter of fixed size (two bits per
key; a fuller filter lets through more candidates and loses none). Windows and shingles that pass are
joined with the items on (class, permutation, minimum) or the shingle, and every candidate pair is
verified on the whole sets: containment = |item and document| / |item| >= ``threshold``.

Shingles are five words, A-Z lower-cased; a text with fewer words is one shingle, so a
shorter item only meets a document that is the same words. Null and empty texts have no
shingles: such an item matches nothing, such a document is clean. Items that repeat an
``item_id`` are items of their own with the same name; repeated document rows give one
result row. A null id stays null in the result. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.words import PIECE, list_column, mix64, pieces, seeds, shingles, signed, word_hashes
from linkweave.operators.joins import broadcast_if_small
from linkweave.session import materialize

SHINGLE = 5
PERMUTATIONS = 64
LEAST_CLASS = 4
EXACT = 1 << LEAST_CLASS
FILTER_BITS = 27
MAX_KEYS = 2_000_000  # keys of 8 bytes that are broadcast in place of a shuffle of the texts
_U = np.uint64
_MUL = seeds(PERMUTATIONS, 501)
_ADD = seeds(PERMUTATIONS, 502)


def size_class(q: int) -> int:
    """The class of an item of more than ``EXACT`` shingles."""
    return (q - 1).bit_length()


def _key(minima: np.ndarray, cls: int, perm: int | np.ndarray) -> np.ndarray:
    return mix64(minima ^ mix64(np.asarray(perm, _U) * _U(64) + _U(cls) + _U(1 << 40)))


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of a key."""
    return key >> _U(64 - FILTER_BITS), (key * _U(0x9E3779B97F4A7C15)) >> _U(64 - FILTER_BITS)


def sequence(words: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes in text order (the same hashes as ``shingles``)."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, k)
    mul = seeds(w, 1000 + w)
    h = np.zeros(n - w + 1, _U)
    for i in range(w):
        h += mix64(words[i:i + n - w + 1] + mul[i]) * mul[i]
    return mix64(h + _U(w))


def _own_keys(shingle: np.ndarray) -> np.ndarray:
    return _key(shingle, 0, 0)  # 0 is no size class


def item_table(items: DataFrame, k: int, t: Fraction) -> DataFrame:
    """``(item_id, item_set, keys)``: distinct shingles and the keys of a short item's shingles or a longer one's minima."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words, first = word_hashes(b.column("text"))
            sets, keys = [], []
            with np.errstate(over="ignore"):
                for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                    s = shingles(words[a:z], k)
                    sets.append(s)
                    if len(s) <= EXACT:
                        least = max(1, math.ceil(t * len(s)))
                        keys.append(_own_keys(s[:max(0, len(s) - least + 1)]))
                    else:
                        low = (s[:, None] * _MUL + _ADD).min(axis=0)
                        keys.append(_key(low, size_class(len(s)), np.arange(len(low))))
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), list_column(signed(np.concatenate(sets)), np.array([len(s) for s in sets])),
                 list_column(signed(np.concatenate(keys)), np.array([len(s) for s in keys]))],
                ["item_id", "item_set", "keys"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(scan, "item_id bigint, item_set array<bigint>, keys array<bigint>").where(F.size("item_set") > 0)
    return materialize(found.withColumn("item", F.xxhash64("item_id", "item_set")), "items")


def bit_filter(keys: DataFrame) -> np.ndarray:
    """The filter of all item keys, at most 2 ** FILTER_BITS bits whatever the number of items."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.concatenate(_places(b.column("key").to_numpy().view(_U))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both)], ["bit"])

    rows = (keys.mapInArrow(bits, "bit bigint")
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 6), _U)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return out


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1


def candidates(docs: DataFrame, bits: np.ndarray, classes: list[int], short: bool, k: int) -> DataFrame:
    """``(doc_id, keys, doc_set)`` of the documents with a window, or with ``short`` items a shingle, that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        base = 1 << LEAST_CLASS
        for b in pieces(batches, PIECE):
            words, first = word_hashes(b.column("text"))
            with np.errstate(over="ignore"):
                seqs = [sequence(words[a:z], k) for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
                n_blocks = np.array([-(-len(s) // base) for s in seqs])
                if not n_blocks.sum():
                    continue
                flat = np.concatenate(seqs)
                length = np.array([len(s) for s in seqs])
                at = (np.cumsum(length) - length).repeat(n_blocks)
                starts = at + (np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)) * base
                hits: list[tuple[np.ndarray, np.ndarray]] = []
                if short:
                    key = _own_keys(flat)
                    one, other = _places(key)
                    on = np.flatnonzero(_has(known, one))
                    on = on[_has(known, other[on])]
                    hits.append((np.repeat(np.arange(len(seqs)), length)[on], key[on]))
                levels = {}
                top = max(classes, default=0)
                nb, doc = n_blocks, np.repeat(np.arange(len(seqs)), n_blocks)
                for cls in range(LEAST_CLASS, top + 1):  # how blocks of one class pair up to the next
                    levels[cls] = doc
                    first_block = np.cumsum(nb) - nb
                    nth = np.arange(len(doc)) - first_block[doc]
                    pair = np.flatnonzero(nth % 2 == 0)
                    levels[cls, "pair"] = pair
                    nb = -(-nb // 2)
                    doc = doc[pair]
                for p in range(PERMUTATIONS if classes else 0):
                    low = np.minimum.reduceat(flat * _MUL[p] + _ADD[p], starts)
                    for cls in range(LEAST_CLASS, top + 1):
                        doc = levels[cls]
                        if cls in classes:
                            two = low.copy()
                            same = doc[1:] == doc[:-1]
                            two[:-1] = np.where(same, np.minimum(low[:-1], low[1:]), low[:-1])
                            key = _key(two, cls, p)
                            one, other = _places(key)
                            on = np.flatnonzero(_has(known, one))
                            on = on[_has(known, other[on])]
                            if len(on):
                                hits.append((doc[on], key[on]))
                        pair = levels[cls, "pair"]
                        low = np.minimum.reduceat(low, pair)
            if not sum(len(h[0]) for h in hits):
                continue
            doc = np.concatenate([h[0] for h in hits])
            key = np.concatenate([h[1] for h in hits])
            rows = np.unique(doc)
            keys = [np.unique(key[doc == r]) for r in rows]
            sets = [np.unique(seqs[r]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows)), list_column(signed(np.concatenate(keys)), np.array([len(x) for x in keys])),
                 list_column(signed(np.concatenate(sets)), np.array([len(x) for x in sets]))],
                ["doc_id", "keys", "doc_set"])

    return materialize(docs.mapInArrow(scan, "doc_id bigint, keys array<bigint>, doc_set array<bigint>"), "windows")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, item_id, n_common, n_item, containment)`` for every document and item in it."""
    t = Fraction(str(threshold))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = item_table(items, k, t)
    keys = known.select("item", F.explode("keys").alias("key"))
    sizes = [r[0] for r in known.select(F.size("item_set")).distinct().collect()]  # as many as there are item lengths
    if not sizes:
        return docs.sparkSession.createDataFrame(
            [], "doc_id bigint, item_id bigint, n_common bigint, n_item bigint, containment double")
    classes = sorted({size_class(q) for q in sizes if q > EXACT})
    found = candidates(docs, bit_filter(keys.select("key")), classes, min(sizes) <= EXACT, k)
    found = found.withColumn("row", F.xxhash64("doc_id", "doc_set"))
    pairs = found.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "item").distinct()
    both = (pairs.join(found.select("row", "doc_id", "doc_set"), "row")
            .join(known.select("item", "item_id", "item_set"), "item"))
    common = F.size(F.array_intersect("item_set", "doc_set")).cast("bigint")
    n_item = F.size("item_set").cast("bigint")
    return (both.select("doc_id", "item_id", common.alias("n_common"), n_item.alias("n_item"))
            .where(F.lit(t.denominator) * F.col("n_common") >= F.lit(t.numerator) * F.col("n_item"))
            .withColumn("containment", F.col("n_common") / F.col("n_item")).distinct())


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; judged by the text alone, so ids may be null or repeated."""
    text = next(c for c in docs.columns if c.lower() == "text")
    keyed = docs.withColumn("decontaminate_key", F.xxhash64(F.col(f"`{text}`").cast("string")))
    bad = contaminated(keyed.select(F.col("decontaminate_key").alias("doc_id"), F.col(f"`{text}`").alias("text")), items, threshold, k)
    # written first: the planner would start to shuffle the texts before it knows how few keys there are
    bad = broadcast_if_small(materialize(bad.select(F.col("doc_id").alias("decontaminate_key")).distinct(), "contaminated"), MAX_KEYS)
    return keyed.join(bad, "decontaminate_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
