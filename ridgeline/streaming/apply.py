"""Frozen models on streams: every function maps rows one by one, so it needs neither state nor a watermark and runs on Structured Streaming as on a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.kernel import Encoder, Ridge
from ridgeline.operators.matcher import Matcher
from ridgeline.operators.tokenizer import FittedTokenizer, word_tokens

#: Up to so many n-grams (16 bytes each) a vocabulary is broadcast to a stream's tasks.
MOST_GRAMS = 4_000_000


def tokenize(docs: DataFrame, fitted: FittedTokenizer, key: str = "doc_id", most: int = MOST_GRAMS) -> DataFrame:
    """(key, cols, vals) of each text: known n-grams and their counts. Where the mode needs tokens, these are the runs of letters and digits."""
    t = fitted.tokenizer
    if t.mode == "tags" or t.focus:
        raise ValueError("streams are tokenized by whole texts, without tags")
    n = fitted.vocab.count()
    if n > most:
        raise ValueError(f"{n} n-grams are too many for a stream; restrict the vocabulary")
    v = fitted.vocab.select("gram", "col").toPandas().sort_values("gram")
    shared = docs.sparkSession.sparkContext.broadcast((v["gram"].to_numpy(np.int64), v["col"].to_numpy(np.int32)))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, cols = shared.value
        for b in batches:
            c, x = [], []
            for text in b.column(1).to_pylist():
                g, count = np.unique(t.keys(*t.render(text or b"", word_tokens(text or b"") if t.mode != "chars" else [], None)), return_counts=True)
                p = np.minimum(np.searchsorted(grams, g), max(grams.size - 1, 0))
                ok = grams[p] == g if grams.size else np.zeros(g.size, bool)
                c.append(cols[p[ok]] if grams.size else np.zeros(0, np.int32))
                x.append(count[ok].astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], [key, "cols", "vals"])

    return docs.select(key, F.encode(F.col("text"), "utf-8").alias("text")).mapInArrow(run, f"{key} {kind}, cols array<int>, vals array<float>")


def match(docs: DataFrame, matcher: Matcher, key: str = "doc_id", longest: bool = True) -> DataFrame:
    """(key, idx, id, s, e) of the matches of each text."""
    return matcher.predict(docs, longest=longest, key=key)


def embed(rows: DataFrame, encoder: Encoder, key: str = "row") -> DataFrame:
    return encoder.encode(rows, key, "code") if encoder.columns is None else encoder.encode_wide(rows, key)


def decide(codes: DataFrame, ridge: Ridge, key: str = "row", threshold: float | None = None) -> DataFrame:
    """(key, label, score) of each row's best label; with a threshold, (key, labels) of all at it or above."""
    s = ridge.regress(codes, key)
    if threshold is not None:
        return s.select(key, F.filter(F.transform("scores", lambda v, i: F.when(v >= threshold, i)), lambda i: i.isNotNull()).alias("labels"))
    top = F.array_max("scores")
    return s.select(key, (F.array_position("scores", top) - 1).cast("int").alias("label"), top.alias("score"))
