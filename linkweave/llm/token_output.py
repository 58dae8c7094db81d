"""Token-id output: texts to ids of a public tokenizer, stored as Simple-8b words.

``write_tokens`` sorts documents by ``doc_id`` (range partitioning plus a sort in every
partition), encodes them, appends the end id to each and writes one record per
document: ``doc_id, shard, shard_start, n_tokens, block_words, words, wide``. ``shard`` is
the range partition, ``shard_start`` the number of ids before the document in it;
``words`` are the little-endian Simple-8b words of the ids, ``block_words`` the words of
every block of 1,024 ids, ``wide`` the escaped values. Spark's committed Parquet
writer is the container, so a lost executor or a repeated task leaves no half shard.
``read_tokens`` decodes records, ``starts`` turns shard positions into corpus positions.

Texts: null or empty gives the end id alone. Rows that repeat a ``doc_id`` stay,
ordered by text; a null ``doc_id`` sorts first. An empty table writes no record.
Texts of any length are encoded whole. Other columns are ignored.

Encoding splits a text into the tokenizer's pre-tokens and looks their ids up in a
table that the worker fills through the tokenizers library (keyed by a 64-bit hash of
the piece). The split is done on whole byte arrays where a text has only ASCII and
U+00C0 to U+00FF letters; any other text, and one with a special token's string in it,
goes through the library as it is.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm import simple8b
from linkweave.llm.words import PIECE, buffers, give_back, list_column, pieces, span_hashes

RECORD = ("doc_id bigint, shard int, shard_start bigint, n_tokens bigint, "
          "block_words array<int>, words binary, wide binary")
KNOWN_PIECES = 1_200_000
SLOTS = 1 << 21
AT_ONCE = 16  # texts of many pieces in one call of the library; AT_ONCE << 8 single pieces

_L, _N, _S, _O, _X = 0, 1, 2, 3, 4
_CLASS = np.full(256, _X, np.uint8)
_CLASS[33:127] = _O
_CLASS[48:58] = _N
_CLASS[65:91] = _CLASS[97:123] = _L
_CLASS[[9, 10, 11, 12, 13, 32]] = _S


def _classes(raw: np.ndarray) -> np.ndarray:
    """Letter, digit, blank or other for every byte; ``_X`` where the quick split has no answer."""
    c = _CLASS[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[lead + 1 < len(raw)]
    tail = raw[lead + 1]
    letter = lead[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)]
    c[letter] = _L
    c[letter + 1] = _L
    return c


def _piece_starts(raw: np.ndarray, c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every pre-token of the byte-level pattern (contractions; runs of letters, digits or others
    with one space before them; blanks)."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = _X, c[:-1]
    glued = np.zeros(n, bool)
    glued[1:] = raw[:-1] == 32
    start = first[:n] | ((c != prev) & ~glued)
    nxt = np.empty(n, np.uint8)
    nxt[-1], nxt[:-1] = _S, c[1:]
    start |= (c == _S) & (nxt != _S) & ~first[1:]
    quote = np.flatnonzero(raw == 39)
    if len(quote):
        quote = quote[start[quote]]
        doc_end = offsets[np.searchsorted(offsets, quote, side="right")]
        room = doc_end - quote
        a = np.where(room > 1, raw[np.minimum(quote + 1, n - 1)], 0)
        b = np.where(room > 2, raw[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, list(b"stmd"))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        after = np.concatenate([quote[one] + 2, quote[two & ~one] + 3])
        start[np.concatenate([quote[one], quote[two & ~one]]) + 1] = False
        start[after[after < n]] = True
    return np.flatnonzero(start)


class PieceTable:
    """Ids of pre-tokens seen so far, filled through the tokenizers library; when it grows too large, only those
    that more than one batch has asked for are kept."""

    def __init__(self, tokenizer_file: str):
        # a task has one core: the library's own threads, one per core of the machine, would each keep memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that start with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.clear()

    def clear(self, room: int = 0) -> None:
        self._index(np.zeros(0, np.uint64), room)
        self.first, self.count, self.asked = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _index(self, hashes: np.ndarray, room: int = 0) -> None:
        """An open-addressing table from the hashes to the rows 0, 1, ..., with room for so many more."""
        self.hashes = hashes
        size = max(SLOTS, 1 << (2 * room).bit_length())
        self.slots, self.slot_rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self._enter(hashes, np.arange(len(hashes), dtype=np.int32))

    def _enter(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.slots[at] == 0
            self.slots[at[free]] = hashes[free]  # of several that want one slot the last one gets it
            got = self.slots[at] == hashes
            self.slot_rows[at[got]] = rows[got]
            hashes, rows, at = hashes[~got], rows[~got], (at[~got] + 1) & mask

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of every hash, -1 where it is not known."""
        out = np.full(len(hashes), -1, np.int32)
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        live = np.arange(len(hashes))
        while len(live):
            seen = self.slots[at]
            hit = seen == hashes[live]
            out[live[hit]] = self.slot_rows[at[hit]]
            on = ~hit & (seen != 0)
            live, at = live[on], (at[on] + 1) & mask
        return out

    def _make_room(self) -> None:
        kept = np.flatnonzero(self.asked > 1)
        if len(kept) > KNOWN_PIECES // 2:
            return self.clear()
        n = self.count[kept].astype(np.int64)
        self.flat = self.flat[np.repeat(self.first[kept] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        self.first, self.count, self.asked, self.used = np.cumsum(n) - n, self.count[kept], np.ones(len(kept), np.uint8), len(self.flat)
        self._index(self.hashes[kept])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, texts: list[str], step: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text), ``step`` texts in a call: the library's results take many times the ids' memory."""
        flat, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(texts), step):
            some = self.encode(texts[lo:lo + step])
            n.append(np.fromiter(map(len, some), np.int64, len(some)))
            flat.append(np.fromiter(chain.from_iterable(some), np.uint32, int(n[-1].sum())))
        return np.concatenate(flat), np.concatenate(n)

    def _learn(self, hashes: np.ndarray, texts: list[bytes], word: np.ndarray) -> None:
        """Add pieces; ``word``: a space and letters."""
        run = np.flatnonzero(word)
        # many " word" pieces in one call: the space starts a pre-token and stands nowhere else in it
        joined = [b"".join([texts[i] for i in run[lo:lo + 1000].tolist()]).decode() for lo in range(0, len(run), 1000)]
        flat, _ = self._encoded(joined, AT_ONCE)
        first = np.flatnonzero(self.opens[flat])
        if len(first) != len(run):
            run, flat, first = run[:0], flat[:0], first[:0]
        alone = np.flatnonzero(~word) if len(run) else np.arange(len(texts))
        other, n_other = self._encoded([texts[i].decode() for i in alone.tolist()], AT_ONCE << 8)
        n = np.concatenate([np.diff(np.append(first, len(flat))), n_other])
        flat = np.concatenate([flat, other])
        while len(self.flat) < self.used + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat) + 1)
        self.flat[self.used:self.used + len(flat)] = flat
        order = np.concatenate([run, alone])
        self._enter(hashes[order], (len(self.count) + np.arange(len(order))).astype(np.int32))
        self.hashes = np.append(self.hashes, hashes[order])
        self.first = np.append(self.first, self.used + np.cumsum(n) - n)
        self.count = np.append(self.count, n.astype(np.int32))
        self.asked = np.append(self.asked, np.zeros(len(n), np.uint8))
        self.used += len(flat)

    def ids(self, raw: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids per piece); ``c``: the classes of the bytes."""
        h = span_hashes(raw, starts, ends, lower=False)
        h[h == 0] = 1  # 0 marks a free slot
        for make_room in (self._make_room, lambda: self.clear(len(h)), None):
            row = self._find(h)
            missing = np.flatnonzero(row < 0)
            new, at = np.unique(h[missing], return_index=True)
            if make_room is None or len(self.count) + len(new) <= KNOWN_PIECES:
                break
            make_room()
        if len(new):
            self._add(raw, c, starts, ends, new, missing[at])
            row = self._find(h)
        seen = np.zeros(len(self.asked), bool)
        seen[row] = True
        self.asked[seen] = np.minimum(self.asked[seen], 1) + 1
        n = self.count[row].astype(np.int64)
        shift = self.first[row] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))], n

    def _add(self, raw, c, starts, ends, hashes, at) -> None:
        data = raw.tobytes()
        s, e = starts[at], ends[at]
        letters = np.concatenate([[0], np.cumsum(c == _L, dtype=np.int64)])
        word = (raw[s] == 32) & (letters[e] - letters[s] == e - s - 1) & (e - s > 1)
        self._learn(hashes, [data[a:b] for a, b in zip(s.tolist(), e.tolist())], word)


_TABLES: dict[str, PieceTable] = {}


def piece_table(tokenizer_file: str) -> PieceTable:
    if tokenizer_file not in _TABLES:
        _TABLES[tokenizer_file] = PieceTable(tokenizer_file)
    return _TABLES[tokenizer_file]


def encode_column(col: pa.Array, tokenizer_file: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with ``end_id`` after each, ids per text)."""
    table = piece_table(tokenizer_file)
    raw, offsets = buffers(col)
    n_docs = len(offsets) - 1
    c = _classes(raw)
    odd = np.flatnonzero(c == _X)
    slow = np.zeros(n_docs, bool)
    slow[np.searchsorted(offsets, odd, side="right") - 1] = True
    data = raw.tobytes()
    for token in table.special:  # a special token's string is cut out by the library first
        at = data.find(token)
        while at >= 0:
            slow[np.searchsorted(offsets, at, side="right") - 1] = True
            at = data.find(token, at + 1)
    if slow.any() and len(raw):  # those texts leave the quick split
        keep = np.repeat(~slow, np.diff(offsets))
        lengths = np.where(slow, 0, np.diff(offsets))
        quick, c = raw[keep], c[keep]
        at = np.concatenate([[0], np.cumsum(lengths)])
    else:
        quick, at = raw, offsets
    if len(quick):
        starts = _piece_starts(quick, c, at)
        ids, n = table.ids(quick, c, starts, np.append(starts[1:], len(quick)))
        total = np.concatenate([[0], np.cumsum(n)])
        lengths = np.diff(total[np.searchsorted(starts, at, side="left")])
    else:
        ids, lengths = np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
    if slow.any():
        rows = np.flatnonzero(slow)
        extra = {}
        for lo in range(0, len(rows), 64):
            part = rows[lo:lo + 64]
            for i, x in zip(part, table.encode([data[offsets[i]:offsets[i + 1]].decode() for i in part])):
                extra[i] = np.array(x, np.uint32)
        cuts = np.cumsum(lengths)[:-1]
        ids = np.concatenate([extra.get(i, x) for i, x in enumerate(np.split(ids, cuts))])
        for i, x in extra.items():
            lengths[i] = len(x)
    out = np.full(len(ids) + n_docs, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n_docs), lengths)] = ids
    return out, lengths + 1


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0) -> None:
    """Encode and write all documents in ascending ``doc_id`` order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, before = TaskContext.get().partitionId(), 0
        for b in pieces(batches, PIECE):
            ids, n = encode_column(b.column("text"), tokenizer_file, end_id)
            words, per_block, wide, n_wide = simple8b.encode(ids, n)
            blocks = -(-n // simple8b.BLOCK)
            n_words = np.add.reduceat(per_block, np.cumsum(blocks) - blocks)
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(start), pa.array(n),
                list_column(per_block.astype(np.int32), blocks), _binary(words, n_words * 8), _binary(wide, n_wide * 8),
            ], ["doc_id", "shard", "shard_start", "n_tokens", "block_words", "words", "wide"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(encode, RECORD).write.parquet(path))


def starts(records: DataFrame) -> DataFrame:
    """``(shard, shard_offset)``: ids of all shards before each shard (one row per shard)."""
    totals = records.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(before, F.lit(0)).alias("shard_offset"))


def decode_batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all records, ids per record)."""
    col = {name: b.column(name) for name in ("n_tokens", "block_words", "words", "wide")}
    n = col["n_tokens"].to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.frombuffer(b"".join(x.as_buffer() for x in col["words"]), "<u8")
    wide = [x.as_buffer().size // 8 for x in col["wide"]]
    values = np.frombuffer(b"".join(x.as_buffer() for x in col["wide"]), "<u8")
    return simple8b.decode(words, col["block_words"].flatten().to_numpy(), n, values, np.array(wide, np.int64)), n


def _records(batches: Iterator[pa.RecordBatch], ids: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``ids`` ids."""
    for b in batches:
        if b.num_rows:
            group = np.cumsum(b.column("n_tokens").to_numpy(zero_copy_only=False)) // ids
            cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                yield b.slice(lo, hi - lo)
    give_back()


def read_tokens(records: DataFrame) -> DataFrame:
    """``(doc_id, shard, shard_start, n_tokens, ids)`` of written records."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _records(batches):
            ids, n = decode_batch(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "shard", "shard_start", "n_tokens")] + [list_column(ids.astype(np.int64), n)],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids"])

    return records.mapInArrow(read, "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids array<bigint>")


def digests(records: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of written records, from the decoded ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _records(batches):
            ids, n = decode_batch(b)
            data, end = ids.astype("<u4"), np.cumsum(n)
            sums = [zlib.crc32(data[a:z].tobytes()) for a, z in zip((end - n).tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "shard", "shard_start", "n_tokens")] + [pa.array(sums, pa.int64())],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    found = records.mapInArrow(crc, "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids_crc32 bigint")
    return (found.join(starts(records), "shard")
            .select("doc_id", (F.col("shard_offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"))
