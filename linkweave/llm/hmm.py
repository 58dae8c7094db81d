"""Hidden Markov language model over words: distributed Baum-Welch, exact likelihood by scaled forward recursion.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end per text. The
model has ``STATES`` latent states; a state emits a word class, the class emits the word:

    P(text) = sum over state paths of  prod A(s, s') * B(s, class(w)) * P(w | class(w))

A word's class is a hash of the word (``CLASS_BITS`` bits, the end has a class of its own),
``P(w | class) = (c + 0.1) / (N_class + 0.1 (V_class + 1))`` with counts over all training
tokens, one share being left for unknown words. So the states see a table of fixed
size while the word table grows with the corpus and is never gathered in one place.

* **Blocks.** Documents are tokenised once into blocks of about ``BLOCK_BYTES`` of text: local
  vocabulary, training counts and the token sequence as local ids. All later passes read blocks.
  A block is several rows, one per ``PIECE`` of text and one per ``SLICE`` of its words, in bytes
  instead of arrays: a task of Spark holds what it reads and sends several times over.
* **Word counts** are summed over all blocks by Spark and joined back to each block.
* **Training.** Every Baum-Welch pass runs over all training documents: each task turns its
  blocks into expected counts, Spark sums them, the driver holds the model (states x classes).
  Sequences are document pieces of up to ``SEGMENT`` tokens, a later piece starting from a
  distribution of its own. The first parameters come from the neighbouring words of all training
  texts: their counts by coarse class (``COARSE_BITS`` bits of the hash), summed by Spark into a
  matrix of fixed size, are factored into states by expectation-maximisation (the best of several
  seeded starts on the driver). Passes go on until one
  gains less than ``SETTLED`` nats a token, ``PASSES`` at most.
* **Scoring.** A whole document is one sequence. The forward recursion runs over all pieces
  side by side, later pieces once per entering state, and the pieces are then chained, so the
  likelihood is exact and a very long text costs no more per token than a short one.

Null or empty text: the end alone. Rows that repeat a ``doc_id`` count and score each. A
null ``doc_id`` is a training row. An empty table gives an empty result; without training
tokens every word is unknown. Words are told apart by a 64-bit hash. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.tables import hash_fold
from linkweave.llm.words import PIECE, give_back, pieces, signed, word_hashes
from linkweave.session import materialize

STATES = 8
CLASS_BITS = 11
SEGMENT = 256
BLOCK_BYTES = 8 * PIECE
SLICE = 1 << 15
PASSES = 7
SETTLED = 0.002
COARSE_BITS = 8
FACTOR_ROUNDS = 200
STARTS = 4
GROUP = 1024
RESCALE = 8  # steps between two rescalings; smoothed emissions are above 1e-30, so eight of them stay in range
END = np.uint64(0xE0D)
_U = np.uint64


class Model:
    """Start, continuation and transition probabilities and class emissions (the end is the last class)."""

    def __init__(self, start: np.ndarray, resume: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.resume, self.move, self.emit = start, resume, move, emit

    @staticmethod
    def first(states: int, classes: np.ndarray, seed: int = 7) -> Model:
        """States that stay mostly as they are, with emissions near the class frequencies."""
        rng = np.random.default_rng(seed)
        flat = np.full(states, 1 / states)
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        emit = (classes + 0.5) * rng.uniform(0.5, 1.5, (states, len(classes)))
        return Model(flat, flat, move, emit / emit.sum(axis=1, keepdims=True))

    @staticmethod
    def from_pairs(pairs: np.ndarray, states: int, classes: np.ndarray, seed: int = 7, rounds: int = FACTOR_ROUNDS) -> Model:
        """States that explain counts of neighbouring coarse classes ``pairs`` (the end is the last of them).

        ``pairs ~ B' J B``: ``J`` is the joint distribution of the states of neighbours, ``B`` their coarse emissions. A class
        takes its state profile from its coarse class and its frequency from ``classes``.
        """
        if not pairs.sum():
            return Model.first(states, classes, seed)
        wide = len(pairs)
        tried = [_factored(pairs, states, stay, seed + i, rounds) for i in range(STARTS) for stay in (0.0, 0.9)]
        joint, emit = max(tried, key=lambda x: float((pairs * np.log(np.maximum(x[1].T @ x[0] @ x[1], 1e-300))).sum()))
        held = joint.sum(axis=1)
        coarse = coarse_of(np.arange(len(classes)), len(classes) - 1, wide - 1)
        fine = (classes + 0.5) / np.bincount(coarse, weights=classes + 0.5, minlength=wide)[coarse] * emit[:, coarse]
        return Model(held, held, joint / held[:, None], fine / fine.sum(axis=1, keepdims=True))

    @staticmethod
    def from_counts(counts: np.ndarray, states: int) -> Model:
        k = states
        start, resume = counts[:k], counts[k:2 * k]
        move, emit = counts[2 * k:2 * k + k * k].reshape(k, k), counts[2 * k + k * k:].reshape(k, -1)
        unit = lambda x, add: (x + add) / (x + add).sum(axis=-1, keepdims=True)
        share = (emit.sum(axis=0) + 0.5) / (emit.sum() + 0.5 * emit.shape[1])  # smoothed towards the class frequencies
        return Model(unit(start, 0.1), unit(resume, 0.1), unit(move, 0.1), unit(emit, 5.0 * share))


def class_of(words: np.ndarray, bits: int) -> np.ndarray:
    out = (words >> _U(64 - bits)).astype(np.int64)
    out[words == END] = 1 << bits
    return out


def _factored(pairs: np.ndarray, states: int, stay: float, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``(J, B)`` of one start; ``stay``: share of the joint distribution that starts on the diagonal."""
    rng = np.random.default_rng(seed)
    wide = len(pairs)
    emit = (pairs.sum(axis=0) + pairs.sum(axis=1) + 0.5) * rng.uniform(0.5, 1.5, (states, wide))
    emit /= emit.sum(axis=1, keepdims=True)
    joint = (1 - stay) * rng.dirichlet(np.ones(states * states)).reshape(states, states) + stay * np.eye(states) / states
    for _ in range(rounds):
        ratio = pairs / np.maximum(emit.T @ joint @ emit, 1e-300)
        grown = joint * (emit @ ratio @ emit.T) + 0.1
        emit = emit * ((joint @ emit) @ ratio.T + (joint.T @ emit) @ ratio) + 0.01 / wide
        emit /= emit.sum(axis=1, keepdims=True)
        joint = grown / grown.sum()
    return joint, emit


def coarse_of(classes: np.ndarray, end: int, coarse_end: int) -> np.ndarray:
    """Coarse class of every class; both ends have a class of their own behind the others."""
    return np.where(classes == end, coarse_end, classes // max(1, end // coarse_end))


def _segments(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first token, length, document, number in the document) of all pieces."""
    n = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(lengths) - lengths)[doc] + nth * size
    return first, np.minimum(size, lengths[doc] - nth * size), doc, nth


def expected_counts(model: Model, tokens: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Baum-Welch counts (start, resume, move, emit) of sequences that lie one after the other."""
    return _expected(model, tokens, lengths, segment)[:-1]


def _expected(model: Model, tokens: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """``expected_counts`` and, last, the log likelihood of the pieces."""
    total = 0.0
    k, classes = model.emit.shape
    start, resume, move = np.zeros(k), np.zeros(k), np.zeros((k, k))
    emit = np.zeros((k, classes))
    table, a, ones = np.ascontiguousarray(model.emit.T), model.move, np.ones(k)
    first, length, _, nth = _segments(lengths, segment)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), GROUP):
        rows = order[lo:lo + GROUP]
        at, size, opening = first[rows], length[rows], nth[rows] == 0
        steps = int(size[0])
        live = np.append(np.searchsorted(-size, -np.arange(steps), side="left"), 0)  # rows longer than t
        seen, alphas, scales = [], [], {}
        for t in range(steps):
            n = live[t]
            token = tokens[at[:n] + t]
            state = np.where(opening[:n, None], model.start, model.resume) if t == 0 else state[:n] @ a
            state *= table.take(token, axis=0)
            if t % RESCALE == RESCALE - 1:
                scales[t] = state @ ones
                state /= scales[t][:, None]
                total += float(np.log(scales[t]).sum())
            seen.append(token)
            alphas.append(state)
        beta = np.empty((len(rows), k))
        for t in range(steps - 1, -1, -1):
            n, m = live[t], live[t + 1]
            if m:
                back = table.take(seen[t + 1], axis=0)
                back *= beta[:m]
                if t + 1 in scales:
                    back /= scales[t + 1][:, None]
                move += alphas[t][:m].T @ back
                np.matmul(back, a.T, out=beta[:m])
            if m < n:  # sequences that end here
                last = alphas[t][m:] @ ones
                total += float(np.log(last).sum())
                beta[m:n] = 1 / last[:, None]
            alphas[t] *= beta[:n]  # posteriors from here on
        gammas = alphas
        start += gammas[0][opening[:live[0]]].sum(axis=0)
        resume += gammas[0][~opening[:live[0]]].sum(axis=0)
        token, gamma = np.concatenate(seen), np.concatenate(gammas).T
        for s in range(k):
            emit[s] += np.bincount(token, weights=gamma[s], minlength=classes)
    return np.concatenate([start, resume, (move * a).ravel(), emit.ravel(), [total]])


def log_likelihoods(model: Model, tokens: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Natural log probability of every class sequence, exact."""
    k = len(model.start)
    table, a, ones = np.ascontiguousarray(model.emit.T), model.move, np.ones(k)
    first, length, doc, nth = _segments(lengths, segment)
    # one row for an opening piece, one per entering state for a later piece
    copies = np.where(nth == 0, 1, k)
    seg = np.repeat(np.arange(len(first)), copies)
    enter = np.arange(len(seg)) - np.repeat(np.cumsum(copies) - copies, copies)
    final, log = np.zeros((len(seg), k)), np.zeros(len(seg))
    order = np.argsort(-length[seg], kind="stable")
    for lo in range(0, len(order), GROUP):
        rows = order[lo:lo + GROUP]
        at, size = first[seg[rows]], length[seg[rows]]
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        state = np.where((nth[seg[rows]] == 0)[:, None], model.start, a[enter[rows]])
        total = np.zeros(len(rows))
        for t in range(steps):
            n = live[t]
            x = table.take(tokens[at[:n] + t], axis=0)
            x *= state[:n] if t == 0 else state[:n] @ a
            if t % RESCALE == RESCALE - 1:
                scale = x @ ones
                x /= scale[:, None]
                total[:n] += np.log(scale)
            state[:n] = x
        scale = state @ ones
        final[rows], log[rows] = state / scale[:, None], total + np.log(scale)
    row = np.cumsum(copies) - copies
    opening = np.flatnonzero(nth == 0)
    state, total = final[row[opening]].copy(), log[row[opening]].copy()
    by_number = np.argsort(nth, kind="stable")
    cut = np.searchsorted(nth[by_number], np.arange(1, (nth.max() if len(nth) else 0) + 2))
    for j in range(1, len(cut)):
        s = by_number[cut[j - 1]:cut[j]]
        d = doc[s]
        r = row[s][:, None] + np.arange(k)
        top = log[r].max(axis=1)
        weight = state[d] * np.exp(log[r] - top[:, None])
        x = np.einsum("di,dij->dj", weight, final[r])
        scale = x.sum(axis=1)
        state[d] = x / scale[:, None]
        total[d] += top + np.log(scale)
    return total


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def packed(ids: np.ndarray, size: int) -> bytes:
    """Ids below ``size`` in two bytes each and a plane of bits for every further bit."""
    further = range(16, max(16, (size - 1).bit_length()))
    return b"".join([ids.astype("<u2").tobytes(), *(np.packbits((ids >> j & 1).astype(np.uint8)).tobytes() for j in further)])


def unpacked(raw: pa.Buffer | bytes, n: int) -> np.ndarray:
    """The ``n`` ids of ``packed``."""
    ids = np.frombuffer(raw, "<u2", n).astype(np.int64)
    for j, plane in enumerate(np.frombuffer(raw, np.uint8, offset=2 * n).reshape(-1, max(1, -(-n // 8)))):
        ids |= np.unpackbits(plane, count=n).astype(np.int64) << (16 + j)
    return ids


class _Block:
    """The pieces of a block: each has ids of its own until the words of all are known."""

    def __init__(self) -> None:
        self.size, self.pieces = 0, []

    def add(self, b: pa.RecordBatch) -> None:
        words, first = word_hashes(b.column("text"))
        n = np.diff(first) + 1
        tokens = np.full(len(words) + len(n), END, _U)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(n)), n - 1)] = words
        vocab, seq = np.unique(tokens, return_inverse=True)
        held = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        count = np.bincount(seq[~np.repeat(held, n)], minlength=len(vocab))
        doc_ids = b.column("doc_id").take(pa.array(np.arange(len(n))))  # a slice would hold the whole batch
        self.pieces.append((doc_ids, held, n, vocab, count, seq.astype(np.int32)))
        self.size += b.column("text").nbytes

    def rows(self, number: int, bits: int) -> Iterator[pa.RecordBatch]:
        """A row for each piece, then the words in slices."""
        words = np.unique(np.concatenate([p[3] for p in self.pieces]))
        vocab = np.append(words[words != END], END)  # in the order of the classes
        per_class = np.bincount(class_of(vocab, bits), minlength=(1 << bits) + 1).astype("<u4").tobytes()
        counts = np.zeros(len(vocab), np.int64)
        for doc_ids, held, lengths, own, count, seq in self.pieces:
            ids = np.searchsorted(vocab[:-1], own)
            ids[own == END] = len(vocab) - 1
            counts[ids] += count
            yield _row(block=pa.array([number]), doc_ids=pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                       held=_list(held, pa.bool_()), lengths=_list(lengths, pa.int64()), per_class=pa.array([per_class]),
                       seq=pa.array([packed(ids[seq], len(vocab))]))
        for lo in range(0, len(vocab), SLICE):
            yield _row(block=pa.array([number]), first=pa.array([lo]), vocab=pa.array([signed(vocab[lo:lo + SLICE]).astype("<i8").tobytes()]),
                       counts=pa.array([counts[lo:lo + SLICE].astype("<i8").tobytes()]))


_STORE = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                    ("lengths", pa.list_(pa.int64())), ("per_class", pa.binary()), ("seq", pa.binary()), ("first", pa.int64()),
                    ("vocab", pa.binary()), ("counts", pa.binary())])


def _row(**given: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(1, f.type)) for f in _STORE], schema=_STORE)


def blocks(docs: DataFrame, held_out: str, bits: int = CLASS_BITS) -> DataFrame:
    """Rows of two kinds, few and of bounded size (but for a longer text), as a task holds a batch of them several times over.

    A row per piece: documents, lengths, local ids of the tokens and how many of the block's words are in each class (of
    ``bits`` bits; local ids are in the order of the classes). A row per slice of a block's words: first local id, hashes and training counts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block()
        for b in pieces(batches, PIECE):
            block.add(b)
            if block.size >= BLOCK_BYTES:
                yield from block.rows(number, bits)
                number, block = number + 1, _Block()
        if block.pieces:
            yield from block.rows(number, bits)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    return materialize(rows.mapInArrow(
        scan, "block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, per_class binary, seq binary, "
              "first bigint, vocab binary, counts binary"), "hmm-blocks")


def words_of(store: DataFrame) -> DataFrame:
    """``(block, place, word, own)``: every block's words by local id, with their training counts."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, own = (np.frombuffer(b.column(c)[i].as_buffer(), "<i8") for c in ("vocab", "counts"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), b.column("block")[i].as_py())), pa.array(b.column("first")[i].as_py() + np.arange(len(words))),
                     pa.array(words), pa.array(own)], ["block", "place", "word", "own"])
        give_back()

    return (store.where("vocab IS NOT NULL").select("block", "first", "vocab", "counts")
            .mapInArrow(listed, "block bigint, place bigint, word bigint, own bigint"))


def _tokens(b: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Local ids of a piece's tokens, class of every local id, lengths and held-out marks of its documents."""
    held, lengths = (np.array(b.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in ("held", "lengths"))
    per_class = np.frombuffer(b.column("per_class")[i].as_buffer(), "<u4")
    return (unpacked(b.column("seq")[i].as_buffer(), int(lengths.sum())), np.repeat(np.arange(len(per_class)), per_class), lengths, held)


def _coarser(classes: np.ndarray, had: int, bits: int) -> np.ndarray:
    """Classes of ``bits`` bits from those of ``had`` bits; the end stays the last."""
    if bits > had:
        raise ValueError(f"blocks with classes of {had} bits cannot be read with {bits}")
    return classes >> (had - bits)


def _training(b: pa.RecordBatch, i: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Class sequence and lengths of a piece's training documents."""
    ids, classes, lengths, held = _tokens(b, i)
    keep = ~held
    had = (len(b.column("per_class")[i].as_buffer()) // 4 - 1).bit_length() - 1
    return _coarser(classes[ids[np.repeat(keep, lengths)]], had, bits), lengths[keep]


def _summed(store: DataFrame, count: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int, size: int) -> np.ndarray:
    """``count(classes, lengths)``, a vector of ``size`` numbers, of all training documents: one vector per task, summed by Spark."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for i in range(b.num_rows):
                tokens, lengths = _training(b, i, bits)
                if len(tokens):
                    total += count(tokens, lengths)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "value"])
        give_back()

    rows = (store.where("seq IS NOT NULL").select("held", "lengths", "per_class", "seq").mapInArrow(estimate, "place bigint, value double")
            .groupBy("place").agg(F.sum("value").alias("value")).toArrow())
    out = np.zeros(size)
    out[rows.column("place").to_numpy()] = rows.column("value").to_numpy()
    return out


def neighbour_counts(store: DataFrame, bits: int) -> np.ndarray:
    """How often a coarse class follows another within a training text."""
    end, wide = 1 << bits, (1 << min(bits, COARSE_BITS)) + 1

    def count(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        coarse = coarse_of(tokens, end, wide - 1)
        within = np.ones(len(tokens), bool)
        within[np.cumsum(lengths) - 1] = False  # nothing follows the end of a text
        first = np.flatnonzero(within)
        return np.bincount(coarse[first] * wide + coarse[first + 1], minlength=wide * wide)

    return _summed(store, count, bits, wide * wide).reshape(wide, wide)


def baum_welch_pass(store: DataFrame, model: Model, bits: int) -> np.ndarray:
    """Expected counts over all training documents and, last, their log likelihood."""
    shared = store.sparkSession.sparkContext.broadcast(model)
    k, classes = model.emit.shape
    out = _summed(store, lambda tokens, lengths: _expected(shared.value, tokens, lengths), bits, 2 * k + k * k + k * classes + 1)
    shared.destroy()
    return out


def train(store: DataFrame, n_class: np.ndarray, states: int = STATES, bits: int = CLASS_BITS, passes: int = PASSES,
          settled: float = SETTLED) -> Model:
    """Model of the training texts of ``store``; ``n_class``: their tokens per class."""
    model, before = Model.from_pairs(neighbour_counts(store, bits), states, n_class), -np.inf
    for _ in range(passes):
        counts = baum_welch_pass(store, model, bits)
        model, now = Model.from_counts(counts[:-1], states), counts[-1] / max(1.0, n_class.sum())
        if now - before < settled:
            break
        before = now
    return model


def score(docs: DataFrame, held_out: str, states: int = STATES, bits: int = CLASS_BITS, passes: int = PASSES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row, trained on rows not held out."""
    store = blocks(docs, held_out, bits)
    words = words_of(store)
    counts = materialize(words.groupBy("word").agg(F.sum("own").alias("count")), "hmm-words")
    number = F.when(F.col("word") == F.lit(int(END)), F.lit(1 << bits)).otherwise(F.shiftrightunsigned("word", 64 - bits))
    totals = (counts.where("count > 0").groupBy(number.alias("class"))
              .agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).toArrow())  # one row per class
    n_class, v_class = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    n_class[totals.column("class").to_numpy()] = totals.column("n").to_numpy()
    v_class[totals.column("class").to_numpy()] = totals.column("v").to_numpy()
    model = train(store, n_class, states, bits, passes)
    shared = docs.sparkSession.sparkContext.broadcast((model, n_class, v_class))

    def judge(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        model, n_class, v_class = shared.value
        total, distinct = n_class.sum(), v_class.sum()
        parts = []
        for i in range(own.num_rows):
            ids, cls, lengths, held = _tokens(own, i)
            if not parts:  # the pieces of a block share their words
                count = np.zeros(len(cls))
                count[known.column("place").to_numpy()] = known.column("count").to_numpy()
                base = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
                within = np.log((count + 0.1) / (n_class[cls] + 0.1 * (v_class[cls] + 1)))
                within[cls == len(n_class) - 1] = 0.0  # the end's class holds the end alone
            first = np.cumsum(lengths) - lengths
            per_doc = lambda x: np.add.reduceat(x[ids], first)
            log = log_likelihoods(model, cls[ids], lengths) + per_doc(within)
            parts.append(pa.table({
                "doc_id": own.column("doc_ids")[i].values, "held_out": pa.array(held), "n_tokens": pa.array(lengths),
                "n_known": pa.array(per_doc((count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(lengths), int(total))),
                "base_score": pa.array(per_doc(base)), "score": pa.array(log / np.log(10))}))
        return pa.concat_tables(parts)

    looked_up = words.select("word", "block", "place").join(counts, "word").select(F.col("block").alias("in_block"), "place", "count")
    return (store.where("seq IS NOT NULL").select("block", "doc_ids", "held", "lengths", "per_class", "seq").groupBy("block")
            .cogroup(looked_up.groupBy("in_block"))
            .applyInArrow(judge, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                 "base_score double, score double"))


def hold_out(docs: DataFrame, modulo: int = 10, remainder: int = 0, name: str = "hmm_held_out") -> DataFrame:
    """``docs`` with the fold of the id's checksum as a boolean column."""
    return docs.withColumn(name, F.coalesce(hash_fold("doc_id", modulo) == remainder, F.lit(False)))
