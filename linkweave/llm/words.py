"""Vectorised word and shingle hashing over Arrow string columns (used inside ``mapInArrow`` tasks).

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A word's 64-bit hash is a
polynomial over a byte table, taken from prefix sums, so no Python loop runs per
word. Texts are worked off in pieces of about ``PIECE`` bytes, which bounds the
memory of a task whatever the length of a text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt)) | _U(1)


_BYTE = seeds(256, 11)
_BYTE_LOWER = _BYTE[_LOWER]
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n + 1).bit_length())
    if size not in _POWERS:
        if size > 2 * PIECE:
            _POWERS.pop(max(_POWERS), None) if len(_POWERS) > 1 else None
        out = []
        for base in (_R, _RINV):
            p = np.full(size + 1, base, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying texts; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_string(col.type) and not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a word never crosses a text's end."""
    word = ~_SPACE[raw]
    brk = np.zeros(len(raw) + 1, bool)
    brk[offsets] = True
    before = np.empty(len(raw), bool)
    after = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = word[:-1]
        after[-1] = False
        after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | brk[:-1]))
    ends = np.flatnonzero(word & (~after | brk[1:])) + 1
    return starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of ``raw[start:end]`` (A-Z lower-cased if ``lower``) for ascending spans, in pieces of bounded memory."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        hi = ends[j - 1]
        up, down = _powers(int(hi - lo))
        acc = np.zeros(hi - lo + 1, _U)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw[lo:hi]] * up[:hi - lo], out=acc[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        h = (acc[e] - acc[s]) * down[s]
        out[i:j] = mix64(h + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word in order, first-word index per text with a closing entry)."""
    raw, offsets = buffers(col)
    starts, ends = spans(raw, offsets)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offsets, side="left")


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingle hashes of one text; fewer words: the whole sequence as one; none: empty."""
    n = len(words)
    if n == 0:
        return np.zeros(0, _U)
    short = n < k
    w = n if short else k
    mul = seeds(w, 1000 + w)
    h = np.zeros(n - w + 1, _U)
    for i in range(w):
        h += mix64(words[i:i + n - w + 1] + mul[i]) * mul[i]
    return np.unique(mix64(h + _U(w)))


def pieces(batches: Iterator[pa.RecordBatch], size: int = 2 * PIECE, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``size`` bytes of text (one longer text stays whole)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // size
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            yield b.slice(lo, hi - lo)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: an idle worker counts against its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's bigint."""
    return x.view(np.int64)


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow list column from concatenated values and row lengths."""
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    if off[-1] > 2**31 - 1:
        raise ValueError("more than 2^31 list values in one batch")
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))
