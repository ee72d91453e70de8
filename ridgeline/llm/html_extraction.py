"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: the visible text between two block-level tags. A block is a vector of its hashed tag path, its hashed words and
a few proportions. A bidirectional LSTM, written in numpy, reads a page's blocks in both directions and labels each as content or not, so that a
block's label depends on the whole page. It is trained on pages whose document is known: a block is content if its words stand in that document's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import mix, shingles, text_buffer, words

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>]+)""", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PATH, WORDS, OTHER = 32, 32, 6
DIMS = PATH + WORDS + OTHER


def blocks(html: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path with class and id words, text, share of its characters within links) of each block with text, in order; blanks are single spaces.

    Unclosed and stray tags are taken as browsers take them in common cases; comments, scripts, styles and titles have no text; an unclosed one of those runs to the end.
    """
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((tuple(w for _, ws in stack for w in ws), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        text = m.group(5)
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                links = 0 if m.group(2) else 1
            continue
        flush()
        if name in _VOID:
            continue
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        for closed in _CLOSES.get(name, ()) + (("p",) if name in _ENDS_P else ()):
            if stack and stack[-1][0] == closed:
                stack.pop()
        stack.append((name, (name, *(f"{name}.{w.lower()}" for c in _CLASS.findall(m.group(4)) for w in c.split()))))
    flush()
    return out


def _hash(text: str) -> np.uint64:
    h, *_ = words(np.frombuffer(("x" + text.encode().hex()).encode(), np.uint8), np.array([0, 1 + 2 * len(text.encode())]))
    return h[0]


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path(path: tuple[str, ...]) -> np.ndarray:
    v = _PATHS.get(path)
    if v is None:
        v = np.zeros(PATH, np.float32)
        for back, w in enumerate(reversed(path)):
            h = int(_hash(w))
            v[h % PATH] += (1 if h >> 40 & 1 else -1) / (1 + 0.3 * back)
        if len(_PATHS) < 50_000:
            _PATHS[path] = v
    return v


def features(page: list[list[tuple[tuple[str, ...], str, float]]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the blocks of all pages, one after another, and the pages' offsets."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in page])]).astype(np.int64)
    x = np.zeros((int(offsets[-1]), DIMS), np.float32)
    if not len(x):
        return x, offsets
    flat = [b for p in page for b in p]
    x[:, :PATH] = np.stack([_path(b[0]) for b in flat])
    data, at = text_buffer(pa.array([b[1] for b in flat], pa.large_string()))
    h, s, e, wo = words(data, at)
    n = np.diff(wo)
    block = np.repeat(np.arange(len(flat)), n)
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    v = np.bincount(block * WORDS + (h % np.uint64(WORDS)).astype(np.int64), weights=sign, minlength=len(flat) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = v / np.sqrt(np.maximum(n, 1))[:, None]
    size = np.diff(at)
    place = np.concatenate([np.linspace(-1, 1, len(p)) if len(p) > 1 else np.zeros(len(p)) for p in page])
    ends = np.array([b[1][-1] in ".!?:;" for b in flat])
    x[:, PATH + WORDS :] = np.stack([np.log1p(n) / 3, [b[2] for b in flat], ends, place, 1 - np.bincount(block, weights=e - s, minlength=len(flat)) / np.maximum(size, 1), np.ones(len(flat))], 1)
    return x, offsets


# --- bidirectional LSTM ----------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time x batch x units) of an LSTM over x (time x batch x dims), and what the way back needs."""
    T, B, H = x.shape[0], x.shape[1], u.shape[0]
    z = x @ w
    h, c = np.zeros((B, H), x.dtype), np.zeros((B, H), x.dtype)
    out, trail = np.zeros((T, B, H), x.dtype), []
    for t in range(T):
        a = z[t] + h @ u
        i, f, o = (_sigmoid(a[:, k * H : (k + 1) * H] + (k == 1)) for k in range(3))
        g = np.tanh(a[:, 3 * H :])
        before, c_before = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            trail.append((i, f, o, g, tc, before, c_before))
    return out, trail


def _back(x: np.ndarray, u: np.ndarray, trail: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input and recurrent weights."""
    T, B, H = dout.shape
    du, dz = np.zeros_like(u), np.zeros((T, B, 4 * H), x.dtype)
    dh, dc = np.zeros((B, H), x.dtype), np.zeros((B, H), x.dtype)
    for t in range(T - 1, -1, -1):
        i, f, o, g, tc, before, c_before = trail[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        du += before.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    return np.einsum("tbd,tbk->dk", x, dz, optimize=True), du


@dataclass
class Labeller:
    weights: list[np.ndarray]  # input and recurrent weights forwards, the same backwards, output

    @staticmethod
    def padded(x: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """time x batch x dims of some pages; the same with each page's blocks reversed; mask."""
        n = np.diff(offsets)[which]
        T = int(n.max(initial=0))
        t = np.arange(T)[:, None]
        mask = t < n
        ahead = offsets[:-1][which] + np.minimum(t, np.maximum(n - 1, 0))
        behind = offsets[:-1][which] + np.clip(n - 1 - t, 0, None)
        return x[ahead] * mask[..., None], x[behind] * mask[..., None], mask

    @staticmethod
    def turned(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Backward states in the blocks' order (and the other way round)."""
        n = mask.sum(axis=0)
        t = np.clip(n - 1 - np.arange(len(mask))[:, None], 0, None)
        return h[t, np.arange(mask.shape[1])] * mask[..., None]

    def probabilities(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each block's probability of being content. Pages are run together with others of about their length."""
        out = np.zeros(len(x), np.float32)
        n = np.diff(offsets)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        at = 0
        while at < order.size:
            end = at + max(1, min(256, 20_000 // int(n[order[min(at + 255, order.size - 1)]])))
            which = order[at:end]
            f, b, mask = self.padded(x, offsets, which)
            h = np.concatenate([_run(f, *self.weights[:2], False)[0], self.turned(_run(b, *self.weights[2:4], False)[0], mask)], 2)
            p = _sigmoid(h @ self.weights[4][:-1] + self.weights[4][-1])
            t, j = np.nonzero(mask)
            out[offsets[:-1][which][j] + t] = p[t, j]
            at = end
        return out

    def gradients(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray, which: np.ndarray) -> tuple[float, list[np.ndarray]]:
        f, b, mask = self.padded(x, offsets, which)
        hf, tf = _run(f, *self.weights[:2], True)
        hb, tb = _run(b, *self.weights[2:4], True)
        h = np.concatenate([hf, self.turned(hb, mask)], 2)
        p = _sigmoid(h @ self.weights[4][:-1] + self.weights[4][-1])
        target = y[offsets[:-1][which] + np.minimum(np.arange(len(mask))[:, None], np.maximum(np.diff(offsets)[which] - 1, 0))]
        total = max(mask.sum(), 1)
        loss = float(-(np.log(np.where(target > 0, p, 1 - p) + 1e-9) * mask).sum() / total)
        d = (p - target) * mask / total
        dw = np.append(np.einsum("tbh,tb->h", h, d), d.sum())
        dh = d[..., None] * self.weights[4][:-1]
        H = hf.shape[2]
        return loss, [*_back(f, self.weights[1], tf, dh[..., :H]), *_back(b, self.weights[3], tb, self.turned(dh[..., H:], mask)), dw]


def train(x: np.ndarray, offsets: np.ndarray, y: np.ndarray, units: int = 16, epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Labeller:
    """Adam on the mean cross-entropy of the blocks."""
    rng = np.random.default_rng(seed)
    shape = [(DIMS, 4 * units), (units, 4 * units)] * 2
    model = Labeller([*(rng.normal(0, s[0] ** -0.5, s).astype(np.float32) for s in shape), np.zeros(2 * units + 1, np.float32)])
    m, v = ([np.zeros_like(w) for w in model.weights] for _ in range(2))
    pages, step = np.flatnonzero(np.diff(offsets) > 0), 0
    for _ in range(epochs):
        order = rng.permutation(pages)
        for at in range(0, order.size, batch):
            step += 1
            _, grads = model.gradients(x, offsets, y, order[at : at + batch])
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.weights[k] = (model.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def block_labels(page: list[tuple[tuple[str, ...], str, float]], text: str) -> np.ndarray:
    """1 for each block of which most runs of three words stand in the text, and for each of fewer words that is a line of the text; else 0."""
    known, _ = shingles(*_words(text), 3)
    lines = {" ".join(line.split()) for line in text.split("\n")}
    out = np.zeros(len(page), np.float32)
    for i, (_, b, _) in enumerate(page):
        h, o = _words(b)
        out[i] = np.isin(shingles(h, o, 3)[0], known).mean() > 0.5 if h.size > 2 else b in lines
    return out


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    h, _, _, o = words(data, np.array([0, data.size]))
    return h, o


#: The number of the document that a page shows, in its url: last of its path, after a language.
DOCUMENT_NUMBER = "[.][a-z]+/[a-z]+/([0-9]+)"


def fit(pages: DataFrame, docs: DataFrame, sample: int = 400, number: str = DOCUMENT_NUMBER) -> Labeller | None:
    """A labeller trained on at most `sample` pages, those whose url hashes least, as far as `docs` has the document whose doc_id is the first group
    of `number` in the url. Of several pages of one page_id, or texts of one doc_id, the least counts. None without any."""
    found = F.expr(f"try_cast(regexp_extract(url, '{number}', 1) AS bigint)")
    chosen = pages.select("page_id", "url", found.alias("n")).where("n IS NOT NULL AND page_id IS NOT NULL").distinct().orderBy(F.xxhash64("url"), "url", "page_id").limit(sample).toPandas()
    if not len(chosen):
        return None
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin([int(n) for n in chosen["n"].unique()])).where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    html = {r.page_id: r.html for r in pages.where(F.col("page_id").isin([int(n) for n in chosen["page_id"].unique()])).where("html IS NOT NULL").groupBy("page_id").agg(F.min("html").alias("html")).collect()}
    known = [(blocks(html[p]), texts[n]) for p, n in zip(chosen["page_id"], chosen["n"]) if p in html and n in texts]
    if not known:
        return None
    x, offsets = features([b for b, _ in known])
    return train(x, offsets, np.concatenate([block_labels(b, t) for b, t in known]))


def extract(pages: DataFrame, docs: DataFrame, least: float = 0.5, sample: int = 400, number: str = DOCUMENT_NUMBER) -> DataFrame:
    """(page_id, text, n_blocks, n_kept) of every row of `pages`: text is its content blocks, one to a line.

    Null html: null text and no blocks. Html without visible text: empty text. Without any page whose document is known (or with empty tables), every block is kept.
    Null page_ids and repeated rows give a row each. Pages of any number of blocks are labelled in one sequence. Other columns aren't read. No shuffle of pages.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit(pages, docs, sample, number))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                html = b.column(1).to_pylist()
                own = [blocks(t) if t else [] for t in html]
                x, offsets = features(own)
                keep = model.value.probabilities(x, offsets) >= least if model.value else np.ones(len(x), bool)
                text = [None if t is None else "\n".join(block[1] for block, k in zip(p, keep[o:]) if k) for t, p, o in zip(html, own, offsets)]
                kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[offsets])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(np.diff(offsets).astype(np.int32)), pa.array(kept.astype(np.int32))], ["page_id", "text", "n_blocks", "n_kept"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_blocks int, n_kept int")
