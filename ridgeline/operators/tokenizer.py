"""N-gram tokenizers over bytes, token-flattened bytes, words and tags, with optional focus spans and region groups.

A text (or each of its focus spans) is rendered to a row of symbols; the n-grams of a row are counted within the row, in one pass without a
shuffle. Fitting takes the distinct n-grams of a corpus and numbers them in the order of their packed keys as signed integers; a fitted
tokenizer keeps n-grams that it knows. All offsets are of bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.containers import ranked
from ridgeline.functions.normalize import fold
from ridgeline.operators.passes import bounded

BASE = 0x9E3779B97F4A7C15
REGIONS = ("before", "open", "inside", "close", "after")
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Tokenizer:
    """Configuration; raises ValueError for combinations that have no meaning."""

    ngram_max: int
    ngram_min: int = 1
    mode: str = "chars"
    normalize: bool = False
    terminals: bool = False
    focus: bool = False
    regions: bool = False
    n_tags: int | None = None
    markers: dict[str, int] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if not 1 <= self.ngram_min <= self.ngram_max:
            raise ValueError("1 <= ngram_min <= ngram_max")
        if self.mode not in ("chars", "flat", "words", "tags"):
            raise ValueError(f"no mode {self.mode}")
        if self.normalize and self.mode != "chars":
            raise ValueError("only characters can be normalised")
        if self.regions and not self.focus:
            raise ValueError("regions are relative to a focus")
        if self.mode == "tags" and not (self.n_tags and 1 <= self.n_tags <= 250):
            raise ValueError("tags need n_tags from 1 to 250")
        if self.mode == "tags":
            pool = list(range(1, 256))
        else:
            pool = [*range(1, 9), *range(14, 32), 127] + ([*range(9, 14), *range(65, 91)] if self.normalize else [])
        names = ["bos", "eos"] * self.terminals + ["open", "close"] * self.focus + ["sep"] * (self.mode == "flat")
        names += [f"tag{i}" for i in range(self.n_tags + 2)] if self.mode == "tags" else []
        if len(names) > len(pool):
            raise ValueError("too many markers")
        object.__setattr__(self, "markers", dict(zip(names, pool)))

    # --- rows ---

    def render(self, text: bytes, tokens: list[tuple[int, int, int]], focus: tuple[int, int] | None) -> tuple[np.ndarray | bytes, int, int]:
        """Symbols of a row, and the positions of its focus marks (its length where there are none)."""
        m, out = self.markers, []
        s, e = (min(max(focus[0], 0), len(text)), min(max(focus[1], 0), len(text))) if focus else (0, 0)
        s = min(s, e)
        if self.mode == "tags":
            row = [m["bos"]] if self.terminals else []
            opened = closed = not self.focus
            for a, _, ty in tokens:
                if not opened and a >= s:
                    row.append(m["open"])
                    opened = True
                if opened and not closed and a >= e:
                    row.append(m["close"])
                    closed = True
                row.append(m[f"tag{self.n_tags + 1 if ty < 0 else min(ty, self.n_tags)}"])
            if opened and not closed:
                row.append(m["close"])
            row += [m["eos"]] if self.terminals else []
            return self._marked(bytes(row))
        cuts = [(0, s), "open", (s, e), "close", (e, len(text))] if self.focus else [(0, len(text))]
        stream = (["bos"] if self.terminals else []) + cuts + (["eos"] if self.terminals else [])
        if self.normalize:
            row, spaced = [], True
            for part in stream:
                if isinstance(part, str):
                    row.append(bytes([m[part]]))
                    spaced = False
                    continue
                piece = _BLANKS.sub(b" ", _fold_bytes(text[part[0] : part[1]]))
                piece = piece[1:] if spaced and piece[:1] == b" " else piece
                if piece:
                    row.append(piece)
                    spaced = piece[-1] == 32
            if row and row[-1][-1] == 32:
                row[-1] = row[-1][:-1]
            return self._marked(b"".join(row))
        if self.mode == "chars":
            for part in stream:
                out.append(bytes([m[part]]) if isinstance(part, str) else text[part[0] : part[1]].translate(_SCRUB))
            return self._marked(b"".join(out))
        inside = np.zeros(len(text) + 2, bool)
        for a, b, *_ in tokens:
            inside[a + 1 : b + 1] = True
        clean = text.translate(_SCRUB)

        def stretches(a: int, b: int, kept: bool) -> tuple[np.ndarray, np.ndarray]:
            """Starts and ends of the stretches of [a, b) within tokens, or outside of them."""
            edges = np.flatnonzero(np.diff(np.concatenate([[not kept], inside[a + 1 : b + 1], [not kept]]) if b > a else np.zeros(2, bool)))
            return edges[::2] + a, edges[1::2] + a

        if self.mode == "flat":
            row, gap = bytearray(), False
            for part in stream:
                if isinstance(part, str):
                    row.append(m[part])
                    gap = False
                    continue
                at = part[0]
                for x, y in zip(*(e.tolist() for e in stretches(*part, True))):
                    if x > at and not gap:
                        row.append(m["sep"])
                    row += clean[x:y]
                    at, gap = y, False
                if part[1] > at and not gap:
                    row.append(m["sep"])
                    gap = True
            return self._marked(bytes(row))
        symbols = [np.array([m[part]], np.uint64) if isinstance(part, str) else _rolling(clean, *stretches(*part, True)) for part in stream]
        row = np.concatenate(symbols) if symbols else np.zeros(0, np.uint64)
        return row, row.size, row.size

    def _marked(self, row: bytes) -> tuple[bytes, int, int]:
        o, c = (row.find(bytes([self.markers[k]])) if self.focus else -1 for k in ("open", "close"))
        return row, len(row) if o < 0 else o, len(row) if c < 0 else c

    def keys(self, row: bytes | np.ndarray, opened: int, closed: int) -> np.ndarray:
        """Packed keys (signed 64 bits) of all n-grams of a row: big-endian bytes up to 8, a rolling hash beyond and for words."""
        a = np.frombuffer(row, np.uint8).astype(np.uint64) if isinstance(row, bytes) else row
        out = []
        for n in range(self.ngram_min, self.ngram_max + 1):
            count = a.size - n + 1
            if count <= 0:
                continue
            k = np.zeros(count, np.uint64)
            packed = isinstance(row, bytes) and n <= 8
            for j in range(n):
                k = (k << np.uint64(8)) | a[j : j + count] if packed else k * np.uint64(BASE) + a[j : j + count]
            if self.regions:
                i = np.arange(count)
                r = np.select([i + n <= opened, i <= opened, i + n <= closed, i <= closed], [0, 1, 2, 3], 4)
                k = (k & np.uint64((1 << 60) - 1)) | (r.astype(np.uint64) << np.uint64(60))
            out.append(k)
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)

    # --- frames ---

    def rows(self, texts: DataFrame, tokens: DataFrame | Callable | str | None = None, focus: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
        """(key, idx, gram, val): n-gram counts of each text, or of each focus span (idx), before any vocabulary.

        tokens: (key, s, e[, ty]), or what finds them in the same pass, without a shuffle: a function of the text's bytes that gives (s, e, ty) in order, or
        "words" for the runs of letters and digits; focus: (key, idx, s, e). Null texts are empty."""
        if isinstance(tokens, str) and tokens != "words":
            raise ValueError(f"no tokens {tokens}")
        find = word_tokens if isinstance(tokens, str) else tokens if callable(tokens) else None
        if self.mode != "chars" and tokens is None:
            raise ValueError(f"mode {self.mode} needs tokens")
        if self.focus and focus is None:
            raise ValueError("this tokenizer needs focus spans")
        x = texts.select(key, F.coalesce(F.encode(F.col("text"), "utf-8"), F.encode(F.lit(""), "utf-8")).alias("text"))
        if self.mode != "chars" and find is None:
            ty = F.col("ty").cast("long") if "ty" in tokens.columns else F.lit(0).cast("long")
            t = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), ty.alias("ty")))).alias("tokens"))
            x = x.join(t, key, "left")
        else:
            x = x.withColumn("tokens", F.lit(None).cast("array<struct<s:long,e:long,ty:long>>"))
        if self.focus:
            x = x.join(focus.select(key, F.col("idx").cast("long").alias("idx"), F.struct(F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).alias("focus")), key)
        else:
            x = x.withColumns({"idx": F.lit(0).cast("long"), "focus": F.lit(None).cast("struct<s:long,e:long>")})
        kind = dict(x.dtypes)[key]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def grams(text: bytes, toks: list[dict] | None, f: dict | None) -> list[np.ndarray]:
                own = find(text) if find else [(t["s"], t["e"], t["ty"]) for t in toks or ()]
                row = self.render(text, own, (f["s"], f["e"]) if f else None)
                return list(np.unique(self.keys(*row), return_counts=True))

            for b in batches:
                results = (grams(text.as_py(), toks.as_py(), f.as_py()) for text, toks, f in zip(b.column(1), b.column(2), b.column(4)))
                yield from bounded(b, [0, 3], results, [key, "idx", "gram", "val"], [pa.int64(), pa.float32()])

        return x.select(key, "text", "tokens", "idx", "focus").mapInArrow(run, f"{key} {kind}, idx long, gram long, val float")

    def fit(self, texts: DataFrame, tokens: DataFrame | Callable | str | None = None, focus: DataFrame | None = None, key: str = "doc_id", known: DataFrame | None = None) -> "FittedTokenizer":
        """A tokenizer that knows the n-grams of the texts (and those of an earlier vocabulary `known`)."""
        grams = self.rows(texts, tokens, focus, key).select("gram")
        return FittedTokenizer(self, number(grams.unionAll(known.select("gram")) if known is not None else grams))


def number(grams: DataFrame) -> DataFrame:
    """(gram, col): distinct grams in signed order, ranked in ranges between their quantiles, so that no task orders all."""
    return ranked(grams.distinct(), "col", ["gram"]).select("gram", F.col("col").cast("int").alias("col"))


@dataclass
class FittedTokenizer:
    tokenizer: Tokenizer
    vocab: DataFrame  # gram, col

    def transform(self, texts: DataFrame, tokens: DataFrame | Callable | str | None = None, focus: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
        """(key, idx, col, val) of the known n-grams: a sparse matrix in long form."""
        return self.tokenizer.rows(texts, tokens, focus, key).join(self.vocab, "gram").select(key, "idx", "col", "val")

    def n_tokens(self) -> int:
        return self.vocab.count()

    def group_offsets(self) -> list[int] | None:
        """Columns before each region and in all, or None without regions."""
        if not self.tokenizer.regions:
            return None
        n = {r["r"]: r["n"] for r in self.vocab.groupBy(F.shiftrightunsigned("gram", 60).alias("r")).agg(F.count("*").alias("n")).collect()}
        return [0, *np.cumsum([n.get(i, 0) for i in range(len(REGIONS))]).tolist()]


def raw_counts(texts: DataFrame, ngram_max: int, ngram_min: int = 1, normalize: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, gram, val): counts of packed byte n-grams of each text without a vocabulary, control characters kept."""
    t = Tokenizer(ngram_max, ngram_min, normalize=normalize)
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams(text: bytes) -> list[np.ndarray]:
            row = t.render(text, [], None)[0] if normalize else text or b""
            return list(np.unique(t.keys(row, len(row), len(row)), return_counts=True))

        for b in batches:
            yield from bounded(b, [0], (grams(text.as_py()) for text in b.column(1)), [key, "gram", "val"], [pa.int64(), pa.float32()])

    return texts.select(key, F.coalesce(F.encode(F.col("text"), "utf-8"), F.encode(F.lit(""), "utf-8")).alias("text")).mapInArrow(run, f"{key} {kind}, gram long, val float")


_SCRUB = bytes(32 if 1 <= b <= 8 or 14 <= b <= 31 or b == 127 else b for b in range(256))


_BLANKS = re.compile(rb"[\x00-\x20\x7f]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_WORDS = re.compile(rb"[A-Za-z0-9]+")
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_tokens(text: bytes) -> list[tuple[int, int, int]]:
    """Runs of ASCII letters and digits, as tokens."""
    return [(*m.span(), 0) for m in _WORDS.finditer(text)]


def _fold_bytes(raw: bytes) -> bytes:
    return raw.translate(_LOWER) if raw.isascii() else fold(raw.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def _rolling(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hashes (h * BASE + byte, from 0) of stretches of a text: differences of one running sum, brought to the end's power."""
    if _POWERS[0].size <= len(text):
        for k, r in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(len(text) + 1, 1 << 16), r, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(np.frombuffer(text, np.uint8) * _POWERS[1][: len(text)], out=total[1:])
    return (total[end] - total[start]) * _POWERS[0][np.maximum(end - 1, 0)]
