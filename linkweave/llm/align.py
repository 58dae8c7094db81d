"""Cross-tokenizer alignment: where the token ends of two tokenizers meet, which tokens overlap, and how often id pairs do.

Tokenizer A is a byte-level BPE file of the tokenizers library and encodes space+text, B is a sentencepiece BPE model and
adds that space itself; neither adds or recognises special tokens in a text. ``align`` gives every document's
counts, its groups and the corpus-wide counts of its linked id pairs.

* **Galloping intersection** (``gallop``, ``overlaps``). Token ends are byte offsets. The shorter end list drives
  an exponential and then a binary search into the longer one, each search starting where an earlier
  element of the list was found; all searches of a level run side by side. Ends that both lists hold cut
  the tokens into groups. The tokens of the longer list that overlap a token of the shorter one lie between the
  ranks of that token's two ends, so links are rank ranges.
* **Spans.** Both tokenizers treat a text's words independently: a text is cut before every space that follows a
  character which is not white space, both have a token end there, and equal spans have equal tokens, groups and links. A
  task aligns every distinct span once and keeps up to ``KNOWN`` of them. A document that holds a span which does
  not decode to its own bytes is encoded whole and counts as without tokens if that does not either.
* **Counts.** A block (``BLOCK_BYTES`` of text) becomes one row: its distinct id pairs with the number of its
  documents that link them, and per document its pairs as gaps in that list. Spark sums the pairs of all blocks,
  takes the maximum of every A id (at most one row per entry of A's vocabulary) and joins the sums back to
  the blocks' lists. So a pair of every document costs one row per block.

Null or empty texts, and texts whose joined tokens differ from space+text, have no tokens: zeros and empty groups. Texts of
any length are aligned whole. Repeated rows and ids stay and count each; rows with a null ``doc_id`` too. An empty table
gives an empty result. Other columns are ignored. Spans are told apart by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.words import PIECE, buffers, give_back, pieces, span_hashes
from linkweave.operators.joins import broadcast_if_small
from linkweave.session import materialize

BLOCK_BYTES = 4 * PIECE
JOINED = 32_768
KNOWN = 800_000
MARK = "▁"
_U = np.uint64


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...`` for ``n[0]`` numbers, then the same for the next."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def gallop(short: np.ndarray, n_short: np.ndarray, long: np.ndarray, n_long: np.ndarray) -> np.ndarray:
    """Index of the first element of ``long`` that is not below each element of ``short``.

    Both hold ascending lists one after the other, of ``n_short`` and ``n_long`` elements; each is searched in its own list.
    """
    nth = np.arange(len(short)) - np.repeat(np.cumsum(n_short) - n_short, n_short)
    floor = np.repeat(np.cumsum(n_long) - n_long, n_short)
    top = np.repeat(np.cumsum(n_long), n_short)
    found = floor.copy()
    stride = 1 << int(nth.max()).bit_length() if len(nth) else 0
    while True:
        # level by level: from the element ``stride`` before, which has been found already
        at = np.flatnonzero(nth & (2 * stride - 1) == stride) if stride else np.flatnonzero(nth == 0)
        low, x, end = found[at - stride] if stride else floor[at], short[at], top[at]
        high = end.copy()
        live, step = np.arange(len(at)), 1
        while len(live):  # exponential search
            probe = low[live] + step - 1
            inside = probe < end[live]
            less = inside & (long[np.where(inside, probe, 0)] < x[live])
            stop = live[inside & ~less]
            high[stop] = low[stop] + step - 1
            low[live[less]] += step
            live, step = live[less], 2 * step
        live = np.flatnonzero(low < high)
        while len(live):  # binary search in the last step
            middle = (low[live] + high[live]) >> 1
            less = long[middle] < x[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        found[at] = low
        if stride == 0:
            return found
        stride = 0 if stride == 1 else stride >> 1


class Aligned:
    """Groups and links of texts whose A and B tokens lie one text after the other."""

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, n_a: np.ndarray, b: np.ndarray, b_ends: np.ndarray, n_b: np.ndarray):
        self.a, self.b = a, b
        swap = n_b < n_a
        ids, ends = np.concatenate([a, b]), np.concatenate([a_ends, b_ends])
        first_a, first_b = np.cumsum(n_a) - n_a, len(a) + np.cumsum(n_b) - n_b
        n_short, n_long = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
        short = ranges(np.where(swap, first_b, first_a), n_short)
        long = ranges(np.where(swap, first_a, first_b), n_long)
        found = gallop(ends[short], n_short, ends[long], n_long)
        common = ends[long[found]] == ends[short]  # every text's last ends meet, so ``found`` is always inside
        # tokens of the longer list from the first that ends behind this token's start to the one that covers its last byte
        low = np.zeros(len(short), np.int64)
        low[1:] = found[:-1] + common[:-1]
        width = found - low + 1
        text = np.repeat(np.arange(len(n_a)), n_short)
        one, other = ids[np.repeat(short, width)].astype(np.int64), ids[long[ranges(low, width)]].astype(np.int64)
        turned = np.repeat(swap[text], width)
        self.pairs = np.where(turned, other, one) << 32 | np.where(turned, one, other)
        self.n_links = np.bincount(text, weights=width, minlength=len(n_a)).astype(np.int64)
        at = np.flatnonzero(common)
        self.n_groups = np.bincount(text[at], minlength=len(n_a))
        in_short, in_long = np.diff(at + 1, prepend=0), np.diff(found[at] + 1, prepend=0)
        self.group_a = np.where(swap[text[at]], in_long, in_short)  # tokens of every group
        self.group_b = np.where(swap[text[at]], in_short, in_long)

    def group_texts(self, names: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text; ``names`` holds the ids' decimals."""
        n = len(self.group_a)
        last = np.zeros(n, bool)
        last[np.cumsum(self.n_groups)[self.n_groups > 0] - 1] = True
        out = np.empty((len(self.a) + len(self.b), 2), object)
        a_before, b_before = np.cumsum(self.group_a) - self.group_a, np.cumsum(self.group_b) - self.group_b
        at_a, at_b = ranges(a_before + b_before, self.group_a), ranges(a_before + self.group_a + b_before, self.group_b)
        out[at_a, 0], out[at_b, 0] = names[self.a], names[self.b]
        out[:, 1] = ","
        end_a = a_before + b_before + self.group_a - 1
        end_b = end_a + self.group_b
        out[end_a, 1] = "|"
        out[end_b, 1] = np.where(last, "\n", ";")
        return "".join(out.ravel().tolist()).split("\n")[:-1]


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spans:
    """The spans that a worker has aligned so far."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(a_file)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        entries = self.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_file)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.blank = self.model.piece_to_id(MARK)
        # a piece with the mark inside would tie a word to the next one
        self.independent = not any(MARK in p.lstrip(MARK) for p in names)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.names = np.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object)
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.hashes, self.rows = np.zeros(0, _U), none
        self.ok, self.n_a, self.n_b, self.n_groups, self.n_links = np.zeros(0, bool), none, none, none, none
        self.uses, self.pairs, self.texts = none, none, []

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        """Every text starts with the space that the model adds; a space alone would be lost."""
        return [ids if t != " " else [self.blank] for t, ids in zip(texts, self.model.encode([t[1:] for t in texts], num_threads=1))]

    def _tokens(self, texts: list[bytes], encode, vocabulary: list[bytes], size: np.ndarray,
                closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text, whether they decode to the text); many closed texts go through one call."""
        n = np.full(len(texts), -1, np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        run = np.flatnonzero(closed)
        cut = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths[run]) // JOINED)) + 1).tolist(), len(run)] if len(run) else [0]
        joined = [b"".join([texts[i] for i in run[lo:hi].tolist()]) for lo, hi in zip(cut, cut[1:])]
        made, flat = [], []
        for lo, hi, data, ids in zip(cut, cut[1:], joined, encode([j.decode() for j in joined])):
            part = run[lo:hi]
            ids = np.array(ids, np.int64)
            ends, want = np.cumsum(size[ids]), np.cumsum(lengths[part])
            if len(ends) and ends[-1] == want[-1] and b"".join([vocabulary[i] for i in ids.tolist()]) == data:
                at = np.searchsorted(ends, want)
                if (ends[at] == want).all():
                    n[part] = np.diff(at + 1, prepend=0)
                    made.append(part)
                    flat.append(ids)
        alone = np.flatnonzero(n < 0)
        ok = np.ones(len(texts), bool)
        for i, ids in zip(alone.tolist(), encode([texts[i].decode() for i in alone.tolist()])):
            ok[i] = b"".join([vocabulary[k] for k in ids]) == texts[i]
            n[i] = len(ids)
            flat.append(np.array(ids, np.int64))
        order = np.concatenate([*made, alone])
        first = np.empty(len(n), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate([*flat, alone[:0]])[ranges(first, n)], n, ok

    def spell(self, texts: list[bytes], closed: np.ndarray) -> tuple[Aligned, np.ndarray, np.ndarray, np.ndarray]:
        """(alignment of the texts that decode to themselves, whether they do, A and B tokens per text or 0)."""
        a, n_a, ok_a = self._tokens(texts, self._encode_a, self.a_bytes, self.a_size, closed)
        b, n_b, ok_b = self._tokens(texts, self._encode_b, self.b_bytes, self.b_size, closed)
        ok = ok_a & ok_b
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        return Aligned(a, np.cumsum(self.a_size[a]), n_a, b, np.cumsum(self.b_size[b]), n_b), ok, n_a, n_b

    def _make_room(self) -> None:
        """Keep the spans that more than one block has asked for, or none if these are too many."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > KNOWN // 2:
            return self.clear()
        row = np.full(len(self.ok), -1, np.int64)
        row[kept] = np.arange(len(kept))
        self.pairs = self.pairs[ranges(self.pair_first()[kept], self.n_links[kept])]
        self.texts = [self.texts[i] for i in kept.tolist()]
        self.ok, self.n_a, self.n_b, self.n_groups, self.n_links = (
            x[kept] for x in (self.ok, self.n_a, self.n_b, self.n_groups, self.n_links))
        self.uses = np.ones(len(kept), np.int64)
        stay = row[self.rows] >= 0
        self.hashes, self.rows = self.hashes[stay], row[self.rows[stay]]

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the distinct spans ``raw[start:end]``, and which of these each span is."""
        h, at, back = np.unique(span_hashes(raw, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.hashes) + len(h) > KNOWN or len(self.pairs) > 16 * KNOWN:
            self._make_room()
        place = np.searchsorted(self.hashes, h)
        known = np.zeros(len(h), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == h[inside]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            texts = [data[s:e] for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
            found, ok, n_a, n_b = self.spell(texts, closed[at[new]])
            rows = len(self.ok) + np.arange(len(new))
            named = iter(found.group_texts(self.names))
            self.texts += [next(named) if good else "" for good in ok.tolist()]
            self.ok, self.n_a, self.n_b = np.append(self.ok, ok), np.append(self.n_a, n_a), np.append(self.n_b, n_b)
            self.n_groups, self.n_links = np.append(self.n_groups, found.n_groups), np.append(self.n_links, found.n_links)
            self.uses, self.pairs = np.append(self.uses, np.zeros(len(new), np.int64)), np.append(self.pairs, found.pairs)
            self.hashes, self.rows = np.insert(self.hashes, place[new], h[new]), np.insert(self.rows, place[new], rows)
            place = np.searchsorted(self.hashes, h)
        rows = self.rows[place]
        self.uses[rows] += 1
        return rows, back

    def pair_first(self) -> np.ndarray:
        return np.cumsum(self.n_links) - self.n_links


_SPANS: dict[tuple[str, str], Spans] = {}


def _spans(a_file: str, b_file: str) -> Spans:
    if (a_file, b_file) not in _SPANS:
        _SPANS[a_file, b_file] = Spans(a_file, b_file)
    return _SPANS[a_file, b_file]


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where a space follows a character that is surely no white space (white space beyond ASCII starts with C2, E1, E2 or E3)."""
    at = np.flatnonzero(raw == 32)
    at = at[at > 0]
    before = raw[at - 1]
    lead = lambda k: np.where(at >= k, raw[np.maximum(at - k, 0)], 0)
    two, three, four = lead(2), lead(3), lead(4)
    ok = (before > 32) & (before < 127)
    ok |= (before >= 128) & ((two >= 0xC3) & (two < 0xE0) | (three == 0xE0) | (three >= 0xE4) & (three < 0xF0) | (four >= 0xF0))
    return at[ok]


class Block:
    """All documents of a batch, aligned span by span."""

    def __init__(self, texts: pa.Array, spans: Spans, digest: bool):
        text_raw, text_at = buffers(texts)
        size = np.diff(text_at)
        full = size > 0
        n_docs = len(size)
        at = np.concatenate([[0], np.cumsum(np.where(full, size + 1, 0))])  # with the space before
        raw = np.full(int(at[-1]), 32, np.uint8)
        raw[np.arange(len(text_raw)) + np.repeat(np.cumsum(full), size)] = text_raw
        opens = np.zeros(len(raw) + 1, bool)
        opens[at] = True
        if spans.independent:
            opens[_cuts(raw)] = True
        starts = np.flatnonzero(opens[:-1])
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        closed = np.ones(len(starts), bool)
        closed[np.searchsorted(starts, at[1:][full]) - 1] = False  # a text's last span may end in white space
        if not spans.independent:
            closed[:] = False
        used, which = spans.look_up(raw, starts, ends, closed)
        row = used[which]
        first = np.searchsorted(starts, at)
        n_spans = np.diff(first)
        doc = np.repeat(np.arange(n_docs), n_spans)
        bad = np.unique(doc[~spans.ok[row]])
        per_doc = lambda x: np.bincount(doc, weights=x[row], minlength=n_docs).astype(np.int64)
        self.n_a, self.n_b, self.n_groups, self.n_links = (per_doc(x) for x in (spans.n_a, spans.n_b, spans.n_groups, spans.n_links))
        names, rows, cut = spans.texts, row.tolist(), first.tolist()
        groups = [";".join([names[r] for r in rows[lo:hi]]) for lo, hi in zip(cut, cut[1:])]
        # distinct pairs of the block, frequent ones first
        n_used = spans.n_links[used]
        self.keys, pair = np.unique(spans.pairs[ranges(spans.pair_first()[used], n_used)], return_inverse=True)
        seen = np.bincount(pair, weights=np.repeat(np.bincount(which, minlength=len(used)), n_used), minlength=len(self.keys))
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, pair = self.keys[order], rank[pair]
        n = n_used[which]
        code = np.repeat(doc * max(1, len(self.keys)), n) + pair[ranges((np.cumsum(n_used) - n_used)[which], n)]
        if len(bad):
            code = code[~np.isin(code // max(1, len(self.keys)), bad)]
            extra = self._whole(bad, [raw[at[i]:at[i + 1]].tobytes() for i in bad.tolist()], spans, groups)
            if len(extra):
                code = self._with(code, extra)
        code, self.times = np.unique(code, return_counts=True)
        owner, pair = code // max(1, len(self.keys)), code % max(1, len(self.keys))
        self.found = np.bincount(pair, minlength=len(self.keys))
        self.distinct = np.bincount(owner, minlength=n_docs)
        gaps = np.diff(pair, prepend=0)
        new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        gaps[new] = pair[new]
        self.gaps = gaps
        self.groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else groups

    def _whole(self, bad: np.ndarray, texts: list[bytes], spans: Spans, groups: list[str]) -> np.ndarray:
        """Documents with a span that does not decode to itself, encoded whole: (document, pair key) of every link."""
        found, ok, n_a, n_b = spans.spell(texts, np.zeros(len(texts), bool))
        self.n_a[bad], self.n_b[bad], self.n_groups[bad], self.n_links[bad] = n_a, n_b, found.n_groups, found.n_links
        named = iter(found.group_texts(spans.names))
        for i, good in zip(bad.tolist(), ok.tolist()):
            groups[i] = next(named) if good else ""
        return np.stack([np.repeat(bad, found.n_links), found.pairs], axis=1)

    def _with(self, code: np.ndarray, extra: np.ndarray) -> np.ndarray:
        owner, pair = code // len(self.keys) if len(self.keys) else code, code % max(1, len(self.keys))
        more = np.setdiff1d(extra[:, 1], self.keys)
        where = np.argsort(np.concatenate([self.keys, more]))
        self.keys = np.concatenate([self.keys, more])
        own = where[np.searchsorted(self.keys[where], extra[:, 1])]
        return np.concatenate([owner, extra[:, 0]]) * len(self.keys) + np.concatenate([pair, own])


def _small(values: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as bytes; those of 255 and more follow apart."""
    wide = values >= 255
    return np.where(wide, 255, values).astype(np.uint8).tobytes(), values[wide].astype("<u4").tobytes()


def _numbers(small: pa.Scalar, wide: pa.Scalar) -> np.ndarray:
    out = np.frombuffer(small.as_buffer(), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(wide.as_buffer(), "<u4")
    return out


_PER_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "distinct")
_BLOCK = ("block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
          "groups array<string>, distinct array<bigint>, gaps binary, wide_gaps binary, times binary, wide_times binary, "
          "keys array<bigint>, found array<bigint>")


def blocks(docs: DataFrame, a_file: str, b_file: str, digest: bool) -> DataFrame:
    """One row per block: its documents' counts and groups, their pairs as places in ``keys``, and in ``found`` the documents per pair."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        spans = _spans(a_file, b_file)
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        for b in pieces(batches, BLOCK_BYTES):
            block = Block(b.column("text"), spans, digest)
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id"))]
            columns += [one(x, pa.int64()) for x in (block.n_a, block.n_b, block.n_groups, block.n_links)]
            columns += [one(block.groups, pa.string()), one(block.distinct, pa.int64())]
            columns += [pa.array([x], pa.binary()) for x in (*_small(block.gaps), *_small(block.times))]
            columns += [one(block.keys, pa.int64()), one(block.found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCK.split(", ")])
            number += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(scan, _BLOCK), "alignment")


def pair_counts(store: DataFrame) -> DataFrame:
    """``(pair, n_docs, best)``: documents that hold each linked id pair; ``best`` if no pair of the same A id has more."""
    entries = store.select(F.explode(F.arrays_zip("keys", "found")).alias("x"))
    counts = materialize(entries.groupBy(F.col("x.keys").alias("pair")).agg(F.sum("x.found").alias("n_docs")), "alignment-pairs")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("n_docs").alias("most"))
    return (counts.withColumn("a", first).join(broadcast_if_small(most), "a")
            .select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")))


def align(docs: DataFrame, a_file: str, b_file: str, digest: bool = True) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` per row.

    ``n_best`` counts the links whose pair has its A id's highest document count, ``count_sum`` adds up the document
    counts of all links. ``groups`` is ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256 as ``groups_sha256``
    (the text of all groups is several times the size of the documents).
    """
    name = "groups_sha256" if digest else "groups"
    store = blocks(docs, a_file, b_file, digest)
    asked = store.select("block", F.posexplode("keys").alias("place", "pair"))
    known = asked.join(pair_counts(store), "pair").select(F.col("block").alias("in_block"), "place", "n_docs", "best")

    def total(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        n_docs, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n_docs[place], best[place] = known.column("n_docs").to_numpy(), known.column("best").to_numpy()
        parts = []
        for i in range(own.num_rows):
            doc = {c: own.column(c)[i].values for c in _PER_DOC}
            n = doc.pop("distinct").to_numpy()
            gaps, times = (_numbers(own.column(c)[i], own.column(f"wide_{c}")[i]) for c in ("gaps", "times"))
            end = np.cumsum(n)
            run = np.concatenate([[0], np.cumsum(gaps)])
            pair = run[1:] - np.repeat(run[end - n], n)
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])
            for column, x in (("n_best", times * best[pair]), ("count_sum", times * n_docs[pair])):
                x = upto(x)
                doc[column] = pa.array(x[end] - x[end - n], pa.int64())
            parts.append(pa.table({c: doc[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
                                  | {name: doc["groups"]}))
        give_back()
        return pa.concat_tables(parts)

    return (store.drop("keys", "found").groupBy("block").cogroup(known.groupBy("in_block"))
            .applyInArrow(total, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                                 f"count_sum bigint, {name} string"))
