"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms are words, runs of symbols and a few shape terms (how much of a text is capitals, symbols, digits or repetition). Of the labelled
sample's terms, those that tell good, toxic and low-quality documents apart beyond chance are kept and weighted by their log odds; a
singular value decomposition of the sample's weighted presence matrix gives the latent axes. Every document is projected on them, and its
cosine with every labelled vector is computed in blocks; its k nearest vote, weighted
by the fourth power of their similarity; those that tie for the last places share these places' votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import _IS_WORD, _splitmix, bound_batches, by_ids, mix, pieces, text_buffer, words, words_of

_IS_SYMBOL = np.array([33 <= b < 127 and not _IS_WORD[b] for b in range(256)])
_SYMBOL_BYTE = np.array([_splitmix(b + 1007) if _IS_SYMBOL[b] else 0 for b in range(256)], np.uint64)
_IS_CAPITAL = np.array([65 <= b < 91 for b in range(256)])
_IS_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_SHAPES, _LEVELS = 4, 8


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all tokens of the texts, not distinct, in the order of their kinds: words, symbol runs, shape terms."""
    n = offsets.size - 1
    h, s, e, at = words(data, offsets)
    text = np.repeat(np.arange(n), np.diff(at))
    g, _, _, gat = words_of(data, offsets, _IS_SYMBOL, _SYMBOL_BYTE)
    symbols = np.diff(gat)
    count = np.diff(at)
    capital = _IS_CAPITAL[data[s]] & _IS_CAPITAL[data[e - 1]] & _IS_CAPITAL[data[np.minimum(s + 1, e - 1)]] & (e - s > 1) if h.size else np.zeros(0, bool)
    digit = _IS_DIGIT[data[s]] if h.size else np.zeros(0, bool)
    key = np.sort((text.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    again = (key[1:] == key[:-1]) if key.size else np.zeros(0, bool)
    repeats = np.bincount((key[1:][again] >> np.uint64(40)).astype(np.int64), minlength=n)
    share = np.stack([np.bincount(text[capital], minlength=n), symbols, np.bincount(text[digit], minlength=n), repeats]) / np.maximum(count + symbols, 1)
    level = np.floor(np.log2(share * 2 ** (_LEVELS - 1) + 2.0**-9) + 1).clip(0, _LEVELS).astype(np.uint64)
    shape = mix(level + (np.arange(_SHAPES, dtype=np.uint64) * np.uint64(64) + np.uint64(1 << 20))[:, None])
    return np.concatenate([text, np.repeat(np.arange(n), symbols), np.tile(np.arange(n), _SHAPES)]), np.concatenate([h, g, shape.ravel()])


def presence(text: np.ndarray, term: np.ndarray, n: int, kept: np.ndarray) -> np.ndarray:
    """n x (kept + 1) matrix of which kept terms (sorted hashes) each text has; the last column is 1 for all."""
    maybe = np.zeros(1 << 16, bool)
    maybe[(kept & np.uint64(0xFFFF)).astype(np.int64)] = True
    hit = maybe[(term & np.uint64(0xFFFF)).astype(np.int64)]
    text, term = text[hit], term[hit]
    at = np.minimum(np.searchsorted(kept, term), max(kept.size - 1, 0))
    ok = kept[at] == term if kept.size else np.zeros(term.size, bool)
    x = np.zeros((n, kept.size + 1), np.float32)
    x[text[ok], at[ok]] = 1
    x[:, -1] = 1
    return x


@dataclass
class Model:
    kept: np.ndarray  # sorted term hashes
    project: np.ndarray  # (terms + 1) x latent
    vectors: np.ndarray  # labelled x latent, of unit length
    good: np.ndarray  # labelled
    k: int

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's share of good among its neighbours' similarity-weighted votes; nan for texts without any word or symbol."""
        n = offsets.size - 1
        text, term = terms(data, offsets)
        z = presence(text, term, n, self.kept) @ self.project
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        out = np.full(n, np.nan)
        some = np.bincount(text, minlength=n) > _SHAPES
        for at in range(0, n, 256):
            c = z[at : at + 256] @ self.vectors.T
            k = min(self.k, c.shape[1])
            kth = np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k]
            above = c > kth[:, None] + 1e-4
            tied = (c >= kth[:, None] - 1e-4) & ~above
            share = (k - above.sum(axis=1)) / tied.sum(axis=1)  # of a vote, for those at the k-th's distance
            vote = np.maximum(c, 1e-6) ** 4 * (above + tied * share[:, None])
            out[at : at + 256] = vote @ self.good / vote.sum(axis=1)
        out[~some] = np.nan
        return out


def leading(square: np.ndarray, latent: int, rounds: int = 40) -> np.ndarray:
    """The leading eigenvectors of a matrix of products, by subspace iteration with twice as many, which takes little more memory than the matrix."""
    v = np.linalg.qr(np.random.default_rng(1).standard_normal((len(square), min(2 * latent, len(square)))))[0]
    for _ in range(rounds):
        v = np.linalg.qr(square @ v)[0]
    values, turn = np.linalg.eigh(v.T @ square @ v)
    return v @ turn[:, np.argsort(-values)[:latent]]


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch):
            text, term = terms(*text_buffer(b.column(1)))
            own = [np.unique(term[text == i]).view(np.int64) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "h", "terms"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, latent: int = 48, k: int = 9, chance: float = 16.0) -> Model | None:
    """A model of at most `sample` labelled documents: half good, a quarter toxic and a quarter of low quality, as far as there are,
    those whose doc_id hashes least. chance: least likelihood-ratio statistic (G) of a term that is kept. None without any labelled document.
    """
    kind = F.when(F.col("toxic") != 0, 1).when(F.col("quality") == 0, 2).otherwise(0)
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("kind"))
    own = own.groupBy("doc_id").agg(F.max("kind").alias("kind"))
    chosen = pd.concat([own.where(F.col("kind") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // (4 if c else 2)).toPandas() for c in range(3)])  # the first of each task, merged
    spark = docs.sparkSession
    bound_batches(spark)
    ids = spark.createDataFrame(chosen[["doc_id"]].astype("int64"), "doc_id long")
    texts = by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h")).where("text IS NOT NULL"), ids, "left_semi")
    t = texts.mapInArrow(_sample_terms, "doc_id long, h long, terms array<long>").toArrow().combine_chunks()
    t = t.take(pa.array(np.lexsort((t.column("h").to_numpy(), t.column("doc_id").to_numpy()))))  # of several texts, the one whose hash is least
    ids, first = np.unique(t.column("doc_id").to_numpy(), return_index=True)
    if not ids.size:
        return None
    y = chosen.set_index("doc_id")["kind"].loc[ids].to_numpy()
    t = t.column("terms").combine_chunks().take(pa.array(first))
    each = np.diff(t.offsets.to_numpy())
    names, at = np.unique(t.flatten().to_numpy(), return_inverse=True)
    names, at, doc = names.view(np.uint64), at.astype(np.int32), np.repeat(np.arange(ids.size, dtype=np.int32), each)
    order = np.argsort(names)
    place = np.empty(order.size, np.int32)
    place[order] = np.arange(order.size, dtype=np.int32)
    names, at = names[order], place[at]
    size = np.bincount(y, minlength=3).astype(float)
    n = size.sum()
    df = np.stack([np.bincount(at[y[doc] == c], minlength=names.size).astype(np.int32) for c in range(3)], 1)
    keep, best = np.zeros(names.size, bool), np.zeros(names.size, np.float32)
    for lo in range(0, names.size, 65536):  # in pieces, as most terms occur once or twice and there are very many
        f = df[lo : lo + 65536].astype(float)
        total, g, odds = f.sum(1), np.zeros(len(f)), np.zeros(len(f))
        for c in range(3):
            for o, of in ((f[:, c], total), (size[c] - f[:, c], n - total)):
                expected = of * size[c] / n
                g += 2 * np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(expected, 1e-9)), 0)
        for c in (1, 2):
            p, q = f[:, c] + 0.5, f[:, 0] + 0.5
            odds = np.maximum(odds, np.abs(np.log(p / np.maximum(size[c] - p + 1, 0.5)) - np.log(q / np.maximum(size[0] - q + 1, 0.5))))
        keep[lo : lo + 65536], best[lo : lo + 65536] = g >= chance, odds
    kept, weight = names[keep], np.append(best[keep].astype(float), 2.0)
    hit = keep[at]
    doc, column = doc[hit], (np.cumsum(keep, dtype=np.int32) - 1)[at[hit]]
    cut = np.searchsorted(doc, np.arange(0, ids.size + 256, 256))

    def part(i: int) -> np.ndarray:
        """Weighted presence of 256 documents."""
        x = np.zeros((min(256, ids.size - i * 256), kept.size + 1))
        x[doc[cut[i] : cut[i + 1]] - i * 256, column[cut[i] : cut[i + 1]]] = 1
        x[:, -1] = 1
        return x * weight

    parts = range(-(-ids.size // 256))
    square = np.zeros((kept.size + 1, kept.size + 1))
    for i in parts:
        x = part(i)
        square += x.T @ x
    axes = leading(square, latent)
    project = (weight[:, None] * axes).astype(np.float32)
    z = np.concatenate([part(i) @ axes for i in parts]).astype(np.float32)
    return Model(kept, project, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12), (y == 0).astype(np.float32), k)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch):
            s = model.scores(*text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, mask=np.isnan(s))], ["doc_id", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.4, sample: int = 4096, **fitting) -> DataFrame:
    """(doc_id, score, keep) for every row of `docs`: keep is score >= least.

    Texts that are null or without any word or symbol have a null score and aren't kept. Without labelled documents nothing is known:
    every score is null, and texts with words are kept. Labels whose columns hold nulls don't count; of several label rows of a document, the worst does.
    Of several texts under a labelled doc_id, the model learns from that whose hash is least.
    Null doc_ids and repeated rows give a row each. Ties: those as near as the k-th share the votes left. Other columns aren't read. No shuffle of texts.
    """
    model = fit(docs, labels, sample, **fitting)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by `sample`
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(lambda it: _score(it, shared.value), "doc_id long, score double")
    return scored.select("doc_id", F.round("score", 6).alias("score"), F.coalesce(F.col("score") >= least, F.lit(False)).alias("keep"))


def quality_filter(docs: DataFrame, labels: DataFrame, least: float = 0.4, sample: int = 4096, **fitting) -> DataFrame:
    """The rows of `docs`, with all their columns, that `quality_scores` keeps; each row is judged by its own text, in place, without a join.
    Rows with a null doc_id go. Columns may have any other names; repeated rows go or stay together; an empty table gives no rows."""
    model = fit(docs, labels, sample, **fitting)
    docs = docs.where("doc_id IS NOT NULL")
    if model is None:
        return docs.where(F.length(F.trim("text")) > 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, f"c{at}"):
                s = shared.value.scores(*text_buffer(b.column(at)))
                yield b.filter(pa.array(np.nan_to_num(s, nan=-1.0) >= least))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots don't pass
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
