"""Main-text extraction: a bidirectional LSTM labels the leaf blocks of a page, in numpy.

A page is read into leaf blocks: runs of text between block-level tags, in page order,
each with its tag path (ancestors with class, id and role words). Scripts, styles,
comments and the head never become blocks. Every block is a vector of hashed path
words, hashed text words and a few sizes; the network reads the whole sequence in both
directions and labels each block as main text or not, so a label depends on the page
around it. The kept blocks, joined by one space, are the page's text.

There are no labelled pages, so the network learns from a teacher on a bounded sample
(at most ``2 * SAMPLE_PAGES`` pages, at most ``TRAIN_LEAVES`` leaves of each): a block is main
text if it stands in an article or main element and in no menu, header, footer, sidebar,
notice, advert, form or comment part. Half of the training pages are altered: their main
element gets another name, and boilerplate parts of many kinds, filled with words of
other pages, are put around and into it. The teacher only labels training pages; the
result comes from the network.

Null or empty html, or html without a main block: empty text. Character references are
decoded, white space inside a block becomes one space. Pages are parsed whole and
nothing is cut off. Repeated rows are extracted alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.nets import Adam, sigmoid
from linkweave.llm.words import word_hashes

PATH_DIMS = 192
WORD_DIMS = 32
SIZES = 4
INPUT = PATH_DIMS + WORD_DIMS + SIZES
HIDDEN = 12
SAMPLE_PAGES = 500
TRAIN_LEAVES = 120
STEPS = 220
TRAIN_BATCH = 24
BATCH_LEAVES = 4000

# Elements that do not end a block, hold no text, or close without an end tag.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style template noscript head svg iframe textarea select option title".split())
RAW_TEXT = frozenset("script style textarea title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                           "main nav ol p pre section table ul".split())
MAIN_WORDS = frozenset("article main".split())
MAIN_CLASSES = ("content", "article-body", "post-content", "entry-content", "story", "main-content", "post", "article")
BOILERPLATE = frozenset("nav header footer aside form menu sidebar ad ads advert advertisement banner cookie cookies consent notice "
                        "newsletter subscribe comments comment respond related share social promo sponsored breadcrumb "
                        "breadcrumbs pagination navbar navigation button dialog complementary contentinfo".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def leaves(page: str) -> list[tuple[tuple[str, ...], str]]:
    """``(path words, text)`` of every leaf block in page order."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    at = 0

    def close_block() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined and not any(name in HIDDEN_TEXT for name, _ in stack):
            out.append((tuple(w for _, words in stack for w in words), joined))

    def pop_to(i: int) -> None:
        close_block()
        del stack[i:]

    pos = 0
    while True:
        m = _TAG.search(page, pos)
        if m is None:
            break
        text.append(page[at:m.start()])
        at = pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a" and not m[1]:  # links count as a feature of the block
                text.append("")
            continue
        if name == "br":
            text.append(" ")
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
            else:
                close_block()
            continue
        close_block()
        shut = CLOSES.get(name, set()) | ({"p"} if name in ENDS_PARAGRAPH else set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in shut:
                pop_to(i)
                break
            if stack[i][0] in ("table", "ul", "ol", "div", "article", "section", "main"):
                break
        if name in VOID or (m[3] or "").endswith("/"):
            continue
        words = [name]
        for v in _NAMES.findall(m[3] or ""):
            for part in ("".join(v)).lower().split():
                words.append("." + part)
                words.extend("." + w for w in _WORD.findall(part) if w != part)
        stack.append((name, tuple(words)))
        if name in RAW_TEXT:  # everything up to the end tag is raw
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            stop = end.start() if end else len(page)
            at = pos = end.end() if end else len(page)
            del stack[-1]
            if name not in HIDDEN_TEXT:
                text.append(page[m.end():stop])
    text.append(page[at:])
    close_block()
    return out


def teacher(path: tuple[str, ...]) -> bool:
    """The rule that labels training blocks."""
    words = {w.lstrip(".") for w in path}
    return not words & BOILERPLATE and bool(words & MAIN_WORDS or any("." + c in path for c in MAIN_CLASSES))


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    got = _PATHS.get(path)
    if got is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        got = np.zeros(PATH_DIMS, np.float32)
        words = list(path)
        h = word_hashes(pa.array([" ".join(w.replace(" ", "") for w in words)]))[0] if words else np.zeros(0, np.uint64)
        got[(h % np.uint64(PATH_DIMS)).astype(np.int64)] = 1.0
        _PATHS[path] = got
    return got


def features(page: list[tuple[tuple[str, ...], str]]) -> np.ndarray:
    """(leaves, INPUT) of one page."""
    n = len(page)
    x = np.zeros((n, INPUT), np.float32)
    if not n:
        return x
    h, first = word_hashes(pa.array([t for _, t in page], pa.large_string()))
    leaf = np.repeat(np.arange(n), np.diff(first))
    words = np.bincount(leaf * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    count = np.diff(first)
    for i, (path, _) in enumerate(page):
        x[i, :PATH_DIMS] = _path_vector(path)
    x[:, PATH_DIMS:PATH_DIMS + WORD_DIMS] = words / np.maximum(count, 1)[:, None]
    x[:, -4] = np.log1p(count) / 5
    x[:, -3] = [t.count(".") / (len(t) + 1) * 20 for _, t in page]
    x[:, -2] = np.arange(n) / n
    x[:, -1] = [len(path) / 20 for path, _ in page]
    return x


class BlockLSTM:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.hidden, self.params = hidden, {}
        for d in "fb":
            self.params[f"x{d}"] = rng.normal(0, 0.15, (INPUT, 4 * hidden)).astype(np.float32)
            self.params[f"u{d}"] = rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1.0
            self.params[f"c{d}"] = bias
        self.params["w"] = rng.normal(0, 0.3, (2 * hidden + INPUT, 1)).astype(np.float32)
        self.params["o"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        h, u = self.hidden, self.params[f"u{d}"]
        fed = x @ self.params[f"x{d}"] + self.params[f"c{d}"]
        steps, batch = mask.shape
        out = np.zeros((steps, batch, h), np.float32)
        state, cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = fed[t] + state @ u
            gate = sigmoid(a[:, :3 * h])
            new = np.tanh(a[:, 3 * h:])
            i, f, o = gate[:, :h], gate[:, h:2 * h], gate[:, 2 * h:]
            m = mask[t][:, None]
            after = (f * cell + i * new) * m
            squashed = np.tanh(after)
            if keep is not None:
                keep.append((t, state, cell, i, f, o, new, squashed, m))
            state, cell = o * squashed * m, after
            out[t] = state
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, B) chance of being main text for blocks ``x`` (T, B, INPUT)."""
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b"), x], axis=2)
        return sigmoid((both @ self.params["w"])[:, :, 0] + self.params["o"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the blocks and its gradients by backpropagation through time."""
        h = self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([*[self._run(x, mask, d, kept[d]) for d in "fb"], x], axis=2)
        p = sigmoid((both @ self.params["w"])[:, :, 0] + self.params["o"])
        n = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
        d_out = ((p - y) * mask / n).astype(np.float32)
        grads = {"w": both.reshape(-1, both.shape[2]).T @ d_out.reshape(-1, 1), "o": d_out.sum(keepdims=True).reshape(1)}
        back = d_out[:, :, None] * self.params["w"][:2 * h, 0]
        for k, d in enumerate("fb"):
            u = self.params[f"u{d}"]
            da_all = np.zeros((*mask.shape, 4 * h), np.float32)
            du = np.zeros_like(u)
            carry_h = np.zeros((mask.shape[1], h), np.float32)
            carry_c = np.zeros_like(carry_h)
            for t, state, cell, i, f, o, new, squashed, m in reversed(kept[d]):
                dh = (carry_h + back[t, :, k * h:(k + 1) * h]) * m
                dc = (carry_c + dh * o * (1 - squashed * squashed)) * m
                da = np.concatenate([dc * new * i * (1 - i), dc * cell * f * (1 - f), dh * squashed * o * (1 - o),
                                     dc * i * (1 - new * new)], axis=1)
                da_all[t] = da
                du += state.T @ da
                carry_h, carry_c = da @ u.T, dc * f
            grads[f"u{d}"] = du
            grads[f"x{d}"] = x.reshape(-1, INPUT).T @ da_all.reshape(-1, 4 * h)
            grads[f"c{d}"] = da_all.sum(axis=(0, 1))
        return float(loss), grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 4, rate: float = 0.02) -> BlockLSTM:
        rng = np.random.default_rng(seed)
        adam = Adam(self.params, steps, rate)
        for _ in range(steps if pages else 0):
            chosen = [pages[i] for i in rng.integers(0, len(pages), TRAIN_BATCH)]
            x, mask = padded([p[0] for p in chosen])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, label) in enumerate(chosen):
                y[:len(label), j] = label
            _, grads = self.gradients(x, mask, y)
            adam.step(grads)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Main-text mask of every page's blocks; pages of like length are worked off together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= BATCH_LEAVES:
                hi += 1
            x, mask = padded([pages[i] for i in order[lo:hi]])
            p = self.probabilities(x, mask)
            for j, i in enumerate(order[lo:hi]):
                out[i] = p[:len(pages[i]), j] > 0.5
            lo = hi
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, 1
    return x, mask


def altered(page: list[tuple[tuple[str, ...], str]], words: list[str], rng: np.random.Generator) -> list[tuple[tuple[str, ...], str]]:
    """A training page with another main element and with boilerplate parts put in."""
    kinds = [("nav", "li"), ("header", "div"), ("footer", "p"), ("aside", "p"), ("form", "label"), ("div", ".sidebar", "p"),
             ("div", ".comments", "p"), ("section", ".comments", "div", ".comment", "p"), ("div", ".cookie", "p"),
             ("div", ".cookie-banner", ".cookie", ".banner"), ("div", ".notice", "p"), ("div", ".ad"), ("div", ".advert", "p"),
             ("div", ".newsletter", "form"), ("div", ".related", "ul", "li"), ("div", ".share"), ("ul", ".menu", "li"),
             ("ol", ".comment-list", ".comment", ".list", "li", "p"), ("div", ".consent"), ("div", ".promo"), ("header", "h2"),
             ("div", ".comment", "p"), ("ul", ".breadcrumb", "li"), ("section", ".reader-comments", ".reader", ".comments", "p")]
    homes = [("main",), ("article",), ("main", "article"), ("div", ".content"), ("div", ".article-body", ".article", ".body"),
             ("div", ".post-content", ".post", ".content"), ("section", ".story"), ("div", ".entry-content", ".entry", ".content"),
             ("main", ".content"), ("div", ".main-content", ".main", ".content")]
    home = homes[rng.integers(len(homes))]
    out = []
    for path, text in page:
        if "article" in path:
            i = path.index("article")
            path = path[:i] + home + path[i + 1:]
        out.append((path, text))
    inside = [i for i, (path, _) in enumerate(out) if teacher(path)]
    for _ in range(rng.integers(1, 6)):
        kind = kinds[rng.integers(len(kinds))]
        root = ("html", "body")
        at = int(rng.choice([0, len(out)]))
        if inside and rng.random() < 0.5:
            root = ("html", "body", *home)
            at = int(inside[rng.integers(len(inside))])
        part = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.choice([1, 2, 4, 10, 30, 60]))
            part.append((root + kind, " ".join(words[i] for i in rng.integers(0, len(words), n))))
        out[at:at] = part
        inside = [i for i, (path, _) in enumerate(out) if teacher(path)]
    return out


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> BlockLSTM:
    """Fit on a bounded sample of ``pages(html)``, chosen by a hash of the html."""
    rows = pages.where("html IS NOT NULL AND length(html) > 0")
    share = (1 << 40) * sample_pages // max(1, rows.count())
    sample = (rows.where(F.xxhash64("html").bitwiseAND(F.lit((1 << 40) - 1)) <= F.lit(share))
              .select(F.substring("html", 1, 200_000).alias("html")).limit(2 * sample_pages).orderBy("html").toArrow())
    rng = np.random.default_rng(21)
    read = [leaves(t)[:TRAIN_LEAVES] for t in sample.column("html").to_pylist()]
    words = [w for page in read for _, t in page[:8] for w in t.split()[:40]] or ["text"]
    read = [p for p in read if p]
    data = []
    for page in read:
        for version in (page, altered(page, words, rng)):
            version = version[:TRAIN_LEAVES]
            data.append((features(version), np.array([teacher(path) for path, _ in version], np.float32)))
    return BlockLSTM().fit(data)


def blocks(pages: DataFrame, model: BlockLSTM) -> DataFrame:
    """``(page_id, url, blocks array<struct(path, text, main)>)`` with the label of every block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found, main in _labelled(batches, model):
            rows = [[{"path": " ".join(p), "text": t, "main": bool(k)} for (p, t), k in zip(page, keep)]
                    for page, keep in zip(found, main)]
            kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("main", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(rows, kind)], ["page_id", "url", "blocks"])

    return _rows(pages).mapInArrow(read, "page_id bigint, url string, blocks array<struct<path:string,text:string,main:boolean>>")


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))


def _labelled(batches: Iterator[pa.RecordBatch], model: BlockLSTM, size: int = 200) -> Iterator[tuple]:
    for whole in batches:
        for lo in range(0, whole.num_rows, size):
            b = whole.slice(lo, size)
            found = [leaves(t) if t else [] for t in b.column("html").to_pylist()]
            yield b, found, model.label([features(p) for p in found])


def extract(pages: DataFrame, model: BlockLSTM) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main blocks of every page joined by one space."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found, main in _labelled(batches, shared.value):
            text = [" ".join(t for (_, t), k in zip(page, keep) if k) for page, keep in zip(found, main)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _rows(pages).mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
