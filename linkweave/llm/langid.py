"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read the UTF-8 bytes of a window forwards and backwards; every
position gets language probabilities, and a document's probabilities are the mean over
all positions of its whole text. Windows are ``WINDOW`` consecutive bytes, the state starts
anew in each, so the cost per byte is the same for any text length.

Training is backpropagation through time with Adam on a bounded sample (the only bound:
``SAMPLE_DOCS`` labelled training documents on average and never more than twice as many,
chosen by a hash of the id, one passage of ``PASSAGE`` characters each, taken at a hashed
place). The languages are the labels of that sample. Language, source and id are not
inputs.

Result per row: ``lang_pred`` (``und`` with score 0 if the text is null or has no letter, or if
there was nothing to learn from), ``score`` the mean probability of that language (0 to
1). Ties go to the language first in alphabetical order. Rows with a null label or text
are not learned from. Repeated rows are predicted alike. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.nets import Adam, sigmoid
from linkweave.llm.words import PIECE, buffers, pieces

HIDDEN = 8
WINDOW = 128
BATCH = 2048
SAMPLE_DOCS = 3000
PASSAGE = 320
STEPS = 350
TRAIN_BATCH = 96
TRAIN_WINDOW = 64
UNDETERMINED = "und"


class ByteGRU:
    """``params[d]``: input table (256 x 3H), recurrent weights (H x 3H) and candidate bias of direction ``d``."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, c = hidden, len(languages)
        self.languages, self.hidden = languages, h
        self.params = {}
        for d in "fb":
            self.params[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.params[f"u{d}"] = rng.normal(0, 0.4 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.params[f"n{d}"] = np.zeros(h, np.float32)
        self.params["w"] = rng.normal(0, 0.3, (2 * h, c)).astype(np.float32)
        self.params["o"] = np.zeros(c, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: list | None = None, lengths: np.ndarray | None = None) -> np.ndarray:
        """States (T, B, H) of one direction; windows shorter than T hold a zero state outside."""
        h, table, u, bias = self.hidden, self.params[f"x{d}"], self.params[f"u{d}"], self.params[f"n{d}"]
        steps, batch = x.shape
        out = np.empty((steps, batch, h), np.float32)
        state = np.zeros((batch, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, r = table[x[t]], state @ u
            gate = sigmoid(a[:, :2 * h] + r[:, :2 * h])
            inner = r[:, 2 * h:] + bias
            new = np.tanh(a[:, 2 * h:] + gate[:, h:] * inner)
            if keep is not None:
                keep.append((t, state, gate, inner, new))
            state = new + gate[:, :h] * (state - new)
            if lengths is not None:
                state *= (t < lengths)[:, None]
            out[t] = state
        return out

    def position_probabilities(self, x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """(T, B, languages) for byte windows ``x`` (T, B)."""
        both = np.concatenate([self._run(x, d, None, lengths) for d in "fb"], axis=2)
        logits = both @ self.params["w"] + self.params["o"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients by backpropagation through time."""
        h = self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        logits = both @ self.params["w"] + self.params["o"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        steps, batch = x.shape
        at = np.arange(batch)
        loss = -np.log(p[:, at, y] + 1e-9).mean()
        p[:, at, y] -= 1
        p /= steps * batch
        grads = {k: np.zeros_like(v) for k, v in self.params.items()}
        grads["w"] = both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2])
        grads["o"] = p.sum(axis=(0, 1))
        back = p @ self.params["w"].T
        for i, d in enumerate("fb"):
            u, g = self.params[f"u{d}"], grads
            carry = np.zeros((batch, h), np.float32)
            for t, state, gate, inner, new in reversed(kept[d]):
                z, r = gate[:, :h], gate[:, h:]
                dh = carry + back[t, :, i * h:(i + 1) * h]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (state - new) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g[f"x{d}"], x[t], da)
                g[f"u{d}"] += state.T @ du
                g[f"n{d}"] += (dn * r).sum(axis=0)
                carry = dh * z + du @ u.T
        return float(loss), grads

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5, rate: float = 0.02) -> ByteGRU:
        """Adam on random windows of the sample."""
        rng = np.random.default_rng(seed)
        usable = np.array([i for i, t in enumerate(texts) if t])
        adam = Adam(self.params, steps, rate)
        for _ in range(steps if len(usable) else 0):
            rows = rng.choice(usable, TRAIN_BATCH)
            x = np.full((TRAIN_WINDOW, TRAIN_BATCH), 32, np.uint8)
            for j, i in enumerate(rows):
                at = rng.integers(0, max(1, len(texts[i]) - TRAIN_WINDOW + 1))
                part = texts[i][at:at + TRAIN_WINDOW]
                x[:len(part), j] = np.frombuffer(part, np.uint8)
            _, grads = self.gradients(x, labels[rows])
            adam.step(grads)
        return self

    def document_probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of every text (zero rows for empty texts)."""
        size = np.diff(offsets)
        n = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), n)
        first = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        length = np.minimum(WINDOW, offsets[doc + 1] - first)
        total = np.zeros((len(size), len(self.languages)))
        padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
        order = np.argsort(-length, kind="stable")
        for lo in range(0, len(order), BATCH):
            rows = order[lo:lo + BATCH]
            steps = int(length[rows[0]])
            x = np.ascontiguousarray(padded[first[rows][:, None] + np.arange(steps)].T)
            even = length[rows[-1]] == steps
            p = self.position_probabilities(x, None if even else length[rows])
            if not even:
                p = p * (np.arange(steps)[:, None] < length[rows])[:, :, None]
            np.add.at(total, doc[rows], p.sum(axis=0, dtype=np.float64))
        return total / np.maximum(size, 1)[:, None]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ByteGRU | None:
    """Fit on a bounded sample of ``docs(doc_id, text, lang)``; None without a labelled text."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    n = rows.count()
    if not n:
        return None
    hashed = F.xxhash64("doc_id")
    share = (1 << 40) * sample_docs // n
    place = F.pmod(F.shiftright(hashed, 8), F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1).cast("int") + 1
    sample = (rows.where(hashed.bitwiseAND(F.lit((1 << 40) - 1)) <= F.lit(share))
              .select(F.col("lang").cast("string").alias("lang"), F.substring("text", place, F.lit(PASSAGE)).alias("text"))
              .limit(2 * sample_docs).orderBy("lang", "text").toArrow())
    langs = sample.column("lang").to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return None
    index = {lang: i for i, lang in enumerate(languages)}
    return ByteGRU(languages).fit([t.encode() for t in sample.column("text").to_pylist()], np.array([index[x] for x in langs]))


def predict(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the whole text (columns of these names are replaced)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = next(c for c in docs.columns if c.lower() == "text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in pieces(batches, 2 * PIECE, text):
            p = net.document_probabilities(*buffers(b.column(text)))
            best = p.argmax(axis=1)
            lettered = b.column("lang_lettered").to_numpy(zero_copy_only=False).astype(bool)
            names = [net.languages[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), lettered.tolist())]
            score = np.where(lettered, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            cols = [b.column(c) for c in in_names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(score)], out_names)

    in_names = list(docs.columns)
    out_names = [*in_names, "lang_pred", "score"]
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    lettered = F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False))
    return docs.withColumn("lang_lettered", lettered).mapInArrow(label, schema)


def accepted(docs: DataFrame, model: ByteGRU | None, min_score: float = 0.3) -> DataFrame:
    """The rows whose text has a language (known with at least ``min_score``); all columns as in ``docs``."""
    text = next(c for c in docs.columns if c.lower() == "text")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{text}`").cast("string").alias("text"))
    marked = predict(plain, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return marked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
