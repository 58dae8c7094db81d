"""Simple-8b coding of unsigned ids in 64-bit words, vectorised with numpy.

Format. A sequence is cut into blocks of ``BLOCK`` values (the last one shorter).
A word's top 4 bits are a selector; the other 60 bits hold ``COUNTS[s]`` values of
``WIDTHS[s]`` bits, the first value lowest. The last word of a block may have unused
places, which are zero. Selector 15 is the escape: the word stands for one value of
more than 60 bits, its payload is the index of that value in the sequence's escape
list. The number of words per block is kept, so every block is found and decoded
without reading the ones before it.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
ESCAPE = 15
# Fixed values of the format: values per word and bits per value of selectors 0 to 14.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
NARROW = 7  # the selectors up to this one hold eight values or more
_U = np.uint64


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    high = values >> _U(32)
    out = np.frexp((values & _U(0xFFFFFFFF)).astype(np.float64))[1]
    if high.any():
        out = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, out)
    return out.astype(np.uint8)


def _fitting(bits: np.ndarray, here: np.ndarray, window: int, selectors: range) -> np.ndarray:
    """The first of the selectors (by descending count) whose width holds the values that follow; else the escape.

    Near a block's end the next block's values are looked at as well, which costs a few bits there and nothing else.
    """
    widest = bits[here[:, None] + np.arange(window)]
    np.maximum.accumulate(widest, axis=1, out=widest)
    choice = np.full(len(here), ESCAPE, np.int64)
    for s in reversed(selectors):
        choice[widest[:, COUNTS[s] - 1] <= WIDTHS[s]] = s
    return choice


def _everywhere(bits: np.ndarray, n: int) -> np.ndarray:
    """``_fitting`` for the selectors from ``NARROW`` on at all of the first ``n`` places, by maxima over windows of doubled length."""
    window = {1: bits}
    for size in (2, 4, 8):
        half = window[size // 2]
        window[size] = np.maximum(half[:-(size // 2)], half[size // 2:])
    choice = np.full(n, ESCAPE, np.uint8)
    for s in reversed(range(NARROW, len(WIDTHS))):
        count = int(COUNTS[s])
        size = 1 << (count.bit_length() - 1)
        widest = np.maximum(window[size][:n], window[size][count - size:count - size + n])
        np.copyto(choice, np.uint8(s), where=widest <= WIDTHS[s])
    return choice


def block_bounds(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, sequence) of every block of sequences that lie one after the other."""
    n = -(-lengths // BLOCK)
    seq = np.repeat(np.arange(len(lengths)), n)
    first = np.cumsum(lengths) - lengths
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
    start = first[seq] + nth * BLOCK
    return start, np.minimum(start + BLOCK, (first + lengths)[seq]), seq


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all sequences, words per block, values too wide for a word, and how many of those each sequence has."""
    values, lengths = values.astype(_U), lengths.astype(np.int64)
    start, end, seq = block_bounds(lengths)
    bits = np.append(_bits(values), np.zeros(COUNTS[0], np.uint8))
    steps = []
    p, live = start.copy(), np.arange(len(start))
    n_words = np.zeros(len(start), np.int64)
    fits = _everywhere(bits, len(values))
    while len(live):  # the next word of every block that has values left
        here, stop = p[live], end[live]
        choice = fits[here].astype(np.int64)
        dense = np.flatnonzero(choice == NARROW)  # as many as fit there: look further ahead
        if len(dense):
            choice[dense] = _fitting(bits, here[dense], int(COUNTS[0]), range(NARROW + 1))
        steps.append((live, here, choice))
        n_words[live] += 1
        after = np.minimum(here + np.append(COUNTS, 1)[choice], stop)
        p[live] = after
        live = live[after < stop]
    total = int(n_words.sum())
    at, sel, block = np.empty(total, np.int64), np.empty(total, np.int64), np.repeat(np.arange(len(start)), n_words)
    first_word = np.cumsum(n_words) - n_words
    for t, (rows, here, choice) in enumerate(steps):
        at[first_word[rows] + t] = here
        sel[first_word[rows] + t] = choice
    words = np.zeros(len(at), _U)
    padded = np.append(values, np.zeros(COUNTS[0], _U))
    for s in range(len(WIDTHS)):
        rows = np.flatnonzero(sel == s)
        if not len(rows):
            continue
        n, w = int(COUNTS[s]), int(WIDTHS[s])
        last = at[rows] + n > end[block[rows]]  # words that the block's end leaves partly empty
        for part, full in ((rows[~last], True), (rows[last], False)):
            word = np.full(len(part), _U(s) << _U(60))
            if w:
                a, stop = at[part], end[block[part]]
                for j in range(n):
                    v = padded[a + j]
                    word |= (v if full else np.where(a + j < stop, v, _U(0))) << _U(w * j)
            words[part] = word
    wide = np.flatnonzero(sel == ESCAPE)
    of = seq[block[wide]]
    n_wide = np.bincount(of, minlength=len(lengths)) if len(wide) else np.zeros(len(lengths), np.int64)
    nth = np.arange(len(wide)) - (np.cumsum(n_wide) - n_wide)[of] if len(wide) else wide
    words[wide] = (_U(ESCAPE) << _U(60)) | nth.astype(_U)
    return words, n_words, values[at[wide]], n_wide


def decode(words: np.ndarray, words_per_block: np.ndarray, lengths: np.ndarray, wide: np.ndarray,
           n_wide: np.ndarray) -> np.ndarray:
    """The values of all sequences, one after the other."""
    lengths = lengths.astype(np.int64)
    start, end, seq = block_bounds(lengths)
    out = np.zeros(int(lengths.sum()), _U)
    if not len(words):
        return out
    block = np.repeat(np.arange(len(start)), words_per_block)
    sel = (words >> _U(60)).astype(np.int64)
    count = np.append(COUNTS, 1)[sel]
    before = np.cumsum(count) - count
    first_word = np.cumsum(words_per_block) - words_per_block
    at = start[block] + before - before[first_word][block]
    for s in range(len(WIDTHS)):
        rows = np.flatnonzero(sel == s)
        n, w = int(COUNTS[s]), int(WIDTHS[s])
        if not len(rows) or not w:
            continue
        a, stop, word = at[rows], end[block[rows]], words[rows]
        for j in range(n):
            inside = a + j < stop
            out[(a + j)[inside]] = ((word >> _U(w * j)) & _U((1 << w) - 1))[inside]
    rows = np.flatnonzero(sel == ESCAPE)
    if len(rows):
        base = (np.cumsum(n_wide) - n_wide)[seq[block[rows]]]
        out[at[rows]] = wide[base + (words[rows] & _U((1 << 60) - 1)).astype(np.int64)]
    return out
