"""Substring deduplication by content-defined boundaries of a gear rolling hash, extended byte by byte.

A boundary stands where the gear hash over the last 32 bytes is the least of ``SPREAD`` in a row, so
boundaries depend on content alone. The ``SEED`` bytes before a boundary are a seed. Any
passage of ``SEED + SPREAD - 1`` = 99 bytes, which is less than 50 words can have, holds a boundary
with its whole seed, at the same place in every document that holds the passage; and as
``SEED >= SPREAD``, the seeds of a longer passage leave no byte between them.

Seeds are told apart by a 64-bit digest: the first occurrence (smallest ``doc_id``, then smallest
start) is kept, any occurrence in a later document repeats it. Seeds in a row that repeat the
same place of the same document form a chain, and every chain is extended to both sides as far as the bytes
equal those of the first document, up to ``FLANK`` (a passage goes on further only where further seeds do).
Extended chains that touch or overlap join to spans, whatever their first documents; a span
begins and ends with a whole word and counts as a repeated passage from ``min_words`` words.

Result of ``repeated_spans``: one row per span, ``(doc_id, first_doc_id, start_byte, end_byte,
n_words, n_chunks)``, bytes of the UTF-8 text, ``first_doc_id`` the smallest document that
keeps one of the span's seeds, ``n_chunks`` the seeds. ``drop_spans`` cuts the spans out of the texts.

``chunk_bounds`` and ``chunk_table`` cut whole texts at gear boundaries (of ``MIN_CHUNK`` to ``MAX_CHUNK``
bytes each) as a chunk store would.

Null or empty text has no seeds and no chunks. Rows that repeat a ``doc_id`` are occurrences of one
document: they do not repeat each other. A null ``doc_id`` is left out (it can be
neither kept nor named). An empty table gives an empty result. Texts are read whole;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.words import _SPACE, PIECE, buffers, pieces, seeds, span_hashes, spans
from linkweave.session import materialize

WINDOW = 32
MASK = 31
MIN_CHUNK = 8
MAX_CHUNK = 96
SEED = 50
SPREAD = 50
FLANK = 256
MIN_WORDS = 50
_GEAR = (seeds(256, 77) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash of the last 32 bytes at every byte, by doubling the window."""
    h = _GEAR[raw]
    width = 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h = h + older
        width *= 2
    return h


def chunk_bounds(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text, ascending, the last one ``len(raw)``."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    marks = []
    for lo in range(0, n, PIECE):  # the window reaches back over the cut, so a cut changes nothing
        a = max(0, lo - WINDOW)
        h = gear_hashes(raw[a:lo + PIECE])[lo - a:]
        # judged on the high bits: low bits of a gear hash see only the last few bytes
        marks.append(lo + 1 + np.flatnonzero((h >> np.uint32(27)) & np.uint32(MASK) == 0))
    ends, last = [], 0
    for m in np.concatenate(marks).tolist():
        if m - last < MIN_CHUNK:
            continue
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK:
            ends.append(m)
            last = m
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if not ends or ends[-1] < n:
        ends.append(n)
    return np.array(ends, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_byte, n_bytes, n_words, digest)`` of every chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4 * PIECE):
            raw, offsets = buffers(b.column("text"))
            ends, rows = [], []
            for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                e = chunk_bounds(raw[a:z])
                ends.append(a + e)
                rows.append(np.full(len(e), i))
            if not ends:
                continue
            end, row = np.concatenate(ends), np.concatenate(rows)
            if not len(end):
                continue
            start = np.concatenate([[0], end[:-1]])
            first, _ = spans(raw, offsets)
            words = np.searchsorted(first, end) - np.searchsorted(first, start)
            digest = span_hashes(raw, start, end, lower=False)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array((start - offsets[row]).astype(np.int64)),
                 pa.array((end - start).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(digest.view(np.int64))],
                ["doc_id", "start_byte", "n_bytes", "n_words", "digest"])

    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .where("doc_id IS NOT NULL AND text IS NOT NULL"))
    return rows.mapInArrow(scan, "doc_id bigint, start_byte bigint, n_bytes int, n_words int, digest bigint")


def seed_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the seeds of all texts, ascending."""
    found = []
    for lo in range(0, len(raw), PIECE):  # sets of SPREAD boundaries that begin in [lo, hi)
        hi = min(len(raw), lo + PIECE)
        a = max(0, lo - WINDOW)
        h = gear_hashes(raw[a:hi + SPREAD - 1])[lo - a:].astype(np.uint64)
        if len(h) < SPREAD:
            break
        low = h << np.uint64(32) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
        width = 1
        while width < SPREAD:
            step = min(width, SPREAD - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        at = np.flatnonzero((offsets[1:] > lo) & (offsets[:-1] < hi))
        begin = np.clip(offsets[at] + SEED - 1 - lo, 0, len(low))  # whole seeds of one text only
        end = np.maximum(begin, np.clip(offsets[at + 1] - SPREAD + 1 - lo, 0, len(low)))
        inside = np.zeros(len(low) + 1, np.int64)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end, -1)
        found.append(lo + np.unique((low & np.uint64(0xFFFFFFFF))[np.cumsum(inside[:-1]) > 0]).astype(np.int64))
    if not found:
        return np.zeros(0, np.int64)
    at = np.unique(np.concatenate(found))
    # far inside a run of one byte every place is a least one, and all seeds are equal: one in SPREAD / 2 will do
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (raw[at[1:]] != raw[at[1:] - 1])
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    at = at[(nth < 2 * SEED) | (nth % (SPREAD // 2) == 0)]
    return at - SEED + 1


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("text_key", F.xxhash64("text"))


def seed_table(texts: DataFrame) -> DataFrame:
    """``(doc_id, text_key, start_byte, digest)`` of every seed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            raw, offsets = buffers(b.column("text"))
            start = seed_starts(raw, offsets)
            if not len(start):
                continue
            row = np.searchsorted(offsets, start, side="right") - 1
            digest = span_hashes(raw, start, start + SEED, lower=False)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), b.column("text_key").take(pa.array(row)),
                 pa.array(start - offsets[row]), pa.array(digest.view(np.int64))],
                ["doc_id", "text_key", "start_byte", "digest"])

    return texts.mapInArrow(scan, "doc_id bigint, text_key bigint, start_byte bigint, digest bigint")


def chains(texts: DataFrame) -> DataFrame:
    """Seeds in a row that repeat one place of an earlier document.

    ``(doc_id, text_key, first_doc_id, lo, hi, first_lo, first_hi, head, tail, n)``: bytes, the digests of the first and last seed, number of seeds.
    """
    found = seed_table(texts)
    # one row per seed and task goes through the shuffle: its first place, and whether there is another document
    first = (found.groupBy("digest").agg(F.min(F.struct("doc_id", "start_byte")).alias("first"), F.max("doc_id").alias("last_doc_id"))
             .where("last_doc_id > first.doc_id")
             .select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start_byte").alias("first_byte")))
    again = (found.join(first, "digest").where("doc_id > first_doc_id")
             .select("doc_id", "text_key", "first_doc_id", (F.col("start_byte") - F.col("first_byte")).alias("shift"), "start_byte", "digest")
             .distinct())
    same = ["doc_id", "text_key", "first_doc_id", "shift"]
    order = Window.partitionBy(*same).orderBy("start_byte")
    gap = F.col("start_byte") - F.lag("start_byte", 1, -SEED - 1).over(order) > SEED
    seed = F.struct("start_byte", "digest")
    return (again.withColumn("chain", F.sum(gap.cast("bigint")).over(order)).groupBy(*same, "chain")
            .agg(F.min(seed).alias("head"), F.max(seed).alias("tail"), F.count(F.lit(1)).alias("n"))
            .withColumn("lo", F.col("head.start_byte")).withColumn("hi", F.col("tail.start_byte") + SEED)
            .select("doc_id", "text_key", "first_doc_id", "lo", "hi", (F.col("lo") - F.col("shift")).alias("first_lo"),
                    (F.col("hi") - F.col("shift")).alias("first_hi"), F.col("head.digest").alias("head"), F.col("tail.digest").alias("tail"), "n"))


def flanks(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``(first_doc_id, first_lo, first_hi, before, after)``: the bytes beside the first occurrences of the chains."""
    wanted = (found.select(F.col("first_doc_id").alias("doc_id"), F.struct("first_lo", "first_hi", "head", "tail").alias("place"))
              .distinct().groupBy("doc_id").agg(F.collect_list("place").alias("places")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out: list[tuple] = []
            for d, text, places in zip(*(b.column(c) for c in ("doc_id", "text", "places"))):
                data, places = text.as_buffer().to_pybytes(), places.as_py()
                raw = np.frombuffer(data, np.uint8)
                ends = np.array([(p["first_lo"], p["first_hi"] - SEED) for p in places]).ravel()
                start = np.unique(ends[ends + SEED <= len(raw)])
                digest = dict(zip(start.tolist(), span_hashes(raw, start, start + SEED, lower=False).view(np.int64).tolist()))
                for p in places:  # of several texts under one doc_id, the one that holds the seed
                    lo, hi = p["first_lo"], p["first_hi"]
                    before = data[max(0, lo - FLANK):lo] if digest.get(lo) == p["head"] else b""
                    after = data[hi:hi + FLANK] if digest.get(hi - SEED) == p["tail"] else b""
                    out.append((d.as_py(), lo, hi, p["head"], p["tail"], before, after))
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             ["first_doc_id", "first_lo", "first_hi", "head", "tail", "before", "after"])

    return texts.join(wanted, "doc_id").mapInArrow(
        cut, "first_doc_id bigint, first_lo bigint, first_hi bigint, head bigint, tail bigint, before binary, after binary").distinct()


def _equal(a: bytes, b: bytes) -> int:
    """Number of leading bytes that are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def passages(data: bytes, places: list[dict], min_words: int) -> list[tuple[int, int, int, int, int]]:
    """``(first_doc_id, start, end, words, seeds)`` of the spans that the extended chains of one text form."""
    found: dict[tuple[int, int, int], list[int]] = {}
    for p in places:
        lo, hi = p["lo"], p["hi"]
        left = _equal(data[max(0, lo - FLANK):lo][::-1], p["before"][::-1])
        right = _equal(data[hi:hi + FLANK], p["after"])
        most = found.setdefault((lo, hi, p["first_doc_id"]), [left, right, p["n"]])
        most[:2] = max(most[0], left), max(most[1], right)
    wide = [(lo - left, hi + right, holder, n) for (lo, hi, holder), (left, right, n) in found.items()]
    joined: list[list[int]] = []
    for lo, hi, holder, n in sorted(wide):
        if joined and lo <= joined[-1][1]:
            last = joined[-1]
            last[1], last[2], last[3] = max(last[1], hi), min(last[2], holder), last[3] + n
        else:
            joined.append([lo, hi, holder, n])
    out = []
    for lo, hi, holder, n in joined:
        word = ~_SPACE[np.frombuffer(data, np.uint8, min(len(data), hi + 1) - max(0, lo - 1), max(0, lo - 1))]
        if lo == 0:
            word = np.concatenate([[False], word])  # as if a space stood before the text, and one behind it
        if hi == len(data):
            word = np.concatenate([word, [False]])
        starts = lo + np.flatnonzero(word[1:-1] & ~word[:-2])
        ends = lo + np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        ends = ends[ends > starts[0]] if len(starts) else ends[:0]
        starts = starts[:len(ends)]
        if len(starts) >= max(1, min_words):
            out.append((holder, int(starts[0]), int(ends[-1]), len(starts), n))
    return out


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages that an earlier document holds already, as spans of the later document."""
    texts = _texts(docs)
    found = materialize(chains(texts), "chunk-chains")
    place = F.struct("lo", "hi", "first_doc_id", "n", "before", "after")
    known = (found.join(flanks(texts, found), ["first_doc_id", "first_lo", "first_hi", "head", "tail"])
             .groupBy("doc_id", "text_key").agg(F.collect_list(place).alias("places")))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for d, text, places in zip(b.column("doc_id"), b.column("text"), b.column("places")):
                rows += [(d.as_py(), *r) for r in passages(text.as_buffer().to_pybytes(), places.as_py(), min_words)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["doc_id", "first_doc_id", "start_byte", "end_byte", "n_words", "n_chunks"])

    return texts.join(known, ["doc_id", "text_key"]).mapInArrow(
        extend, "doc_id bigint, first_doc_id bigint, start_byte bigint, end_byte bigint, n_words bigint, n_chunks bigint").distinct()


def drop_spans(docs: DataFrame, spans_found: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the spans cut out of ``text`` (characters cut by a chunk boundary go with the span)."""
    cuts = spans_found.groupBy(F.col("doc_id").alias("cut_id")).agg(
        F.array_sort(F.collect_list(F.struct("start_byte", "end_byte"))).alias("cut_spans"))
    low = [c.lower() for c in docs.columns]
    kept_as = [f"c{i}" for i in range(len(low))]  # own names inside, so no column of the table can clash
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept_as)])
    text = kept_as[low.index("text")]
    joined = plain.join(cuts, F.col(kept_as[low.index("doc_id")]) == F.col("cut_id"), "left").drop("cut_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, gone in zip(b.column(text).to_pylist(), b.column("cut_spans").to_pylist()):
                if t is not None and gone:
                    data, kept, at = t.encode(), [], 0
                    for s in gone:
                        kept.append(data[at:s["start_byte"]])
                        at = s["end_byte"]
                    t = b"".join([*kept, data[at:]]).decode(errors="ignore")
                out.append(t)
            columns = [pa.array(out, pa.string()) if k == text else b.column(k) for k in kept_as]
            yield pa.RecordBatch.from_arrays(columns, kept_as)

    return joined.mapInArrow(cut, plain.schema).toDF(*docs.columns)


def chunk_table(docs: DataFrame) -> DataFrame:
    """The distinct chunks as a store would keep them: digest, first document, bytes, number of occurrences."""
    return materialize(chunks(docs).groupBy("digest").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.count(F.lit(1)).alias("occurrences")), "chunk-table")
