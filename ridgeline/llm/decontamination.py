"""Benchmark decontamination: look-up of the items' rarest weighted shingles, exact verification of all stretches around them.

SimHash of item-sized windows with its multi-index Hamming search is here, too, but isn't what `contamination` searches by: at the similarities
that count as a hit, fingerprints differ in too many bits to be told from those of unrelated texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import bound_batches, hidden, lowered, pieces, shingles, text_buffer, words

K = 2  # words in a shingle
BLOCKS, BLOCK_BITS = 4, 16


# --- SimHash of windows ----------------------------------------------------------------------------------------------


class Planes:
    """Running counts of set bits in each of the 64 bit planes of a sequence of hashes, several planes to a machine word.

    The difference of two running counts is right in every lane as long as a window's count fits in a lane.
    """

    def __init__(self, h: np.ndarray, longest: int):
        self.bits = 8 if longest <= 255 else 16 if longest <= 65535 else 32
        self.lanes = 64 // self.bits
        v = np.arange(1 << self.lanes, dtype=np.uint64)
        table = np.zeros(v.size, np.uint64)
        for j in range(self.lanes):
            table |= ((v >> np.uint64(j)) & np.uint64(1)) << np.uint64(j * self.bits)
        parts = h[:, None].view(np.uint8) if self.lanes == 8 else (h[:, None] >> (np.arange(64 // self.lanes, dtype=np.uint64) * np.uint64(self.lanes))) & np.uint64((1 << self.lanes) - 1)
        self.sums = np.zeros((h.size + 1, 64 // self.lanes), np.uint64)
        np.cumsum(table[parts], axis=0, out=self.sums[1:])

    def fingerprints(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bit b is set if more than half of the hashes in [start, end) have it set."""
        ones = np.uint64(sum(1 << (j * self.bits) for j in range(self.lanes)))
        lift = ((1 << (self.bits - 1)) - 1 - ((end - start) >> 1)).astype(np.uint64) * ones
        top = ones << np.uint64(self.bits - 1)
        out = np.empty(start.size, np.uint64)
        for at in range(0, start.size, 8192):  # so that the counts stay in cache
            part = slice(at, at + 8192)
            x = self.sums.take(end[part], axis=0)
            x -= self.sums.take(start[part], axis=0)
            x += lift[part, None]
            x &= top
            x >>= np.uint64(self.bits - 1)
            if self.lanes == 8:
                x *= np.uint64(0x0102040810204080)
                x >>= np.uint64(56)
                out[part] = x.astype(np.uint8).view(np.uint64)[:, 0]
            else:
                bits = sum((x >> np.uint64(j * (self.bits - 1))) & np.uint64(1 << j) for j in range(self.lanes))
                out[part] = (bits << (np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(self.lanes))).sum(axis=1, dtype=np.uint64)
        return out


def size_class(n: int) -> int:
    """The window size, in shingles, by which items of n shingles are searched; within 3 % of n."""
    return n if n <= 16 else round(16 * 1.06 ** round(np.log(n / 16) / np.log(1.06)))


def windows(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of windows: every size // 7 shingles (1 at least) and at each text's end; a shorter text is one window."""
    step = max(1, size // 7)
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(0, -(-(n - size) // step)) + 1, 0)
    text = np.repeat(np.arange(n.size), count)
    first = np.cumsum(count) - count
    start = (np.arange(text.size) - first[text]) * step
    start = offsets[text] + np.minimum(start, np.maximum(n[text] - size, 0))
    return start, np.minimum(start + size, offsets[text + 1]), text


# --- items -----------------------------------------------------------------------------------------------------------


def weights(length: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Each shingle's weight: the bytes of its words. Long words are rare; frequent ones are short."""
    total = np.concatenate([[0], np.cumsum(length)])
    first = np.repeat(offsets[:-1] - out[:-1], np.diff(out)) + np.arange(out[-1])
    return (total[np.minimum(first + K, np.repeat(offsets[1:], np.diff(out)))] - total[first]).astype(np.int64)


class Index:
    """Fingerprints of a set of items by window size, and for each block of bits the items within radius // BLOCKS of each value:
    if two fingerprints differ in at most `radius` bits, some block differs in at most radius // BLOCKS."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, radius: int):
        h, s, e, at = words(data, offsets)
        sh, so = shingles(h, at, K)
        w = weights(e - s, at, so)
        self.radius, self.ids, self.classes = radius, ids, {}
        self.items = []
        for i in range(ids.size):
            own, where, count = np.unique(sh[so[i] : so[i + 1]], return_index=True, return_counts=True)
            self.items.append((own, count, w[so[i] : so[i + 1]][where]))
        size = np.array([size_class(int(n)) for n in np.diff(so)], int) if ids.size else np.zeros(0, int)
        self.longest = int(np.diff(so).max(initial=0))
        if not self.longest:
            return
        self.longest = max(self.longest, int(size.max()))
        prints = Planes(sh, self.longest).fingerprints(so[:-1], so[1:])
        masks = np.array([sum(1 << b for b in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), r)], np.int64)
        for c in np.unique(size[size > 0]):
            members = np.flatnonzero(size == c)
            blocks = []
            for b in range(BLOCKS):
                value = ((prints[members] >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
                bucket = (value[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(bucket, kind="stable")
                start = np.zeros((1 << BLOCK_BITS) + 1, np.int32)
                np.cumsum(np.bincount(bucket, minlength=1 << BLOCK_BITS), out=start[1:])
                blocks.append((start, np.repeat(members, masks.size)[order].astype(np.int32)))
            self.classes[int(c)] = blocks
        self.prints = prints

    def within(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) of a class whose fingerprints differ in at most `radius` bits."""
        found = []
        for b, (start, members) in enumerate(self.classes[size]):
            key = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            n = start[key + 1] - start[key]
            hit = np.flatnonzero(n)
            n = n[hit]
            window = np.repeat(hit, n)
            item = members[np.repeat(start[key[hit]] - (np.cumsum(n) - n), n) + np.arange(window.size)]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(window[near] * np.int64(self.ids.size) + item[near])
        return np.divmod(np.unique(np.concatenate(found)), self.ids.size)

    def similarity(self, item: int, part: np.ndarray) -> float:
        """Share of the item's weighted shingles, with multiplicity, that the shingles `part` hold."""
        own, count, w = self.items[item]
        part = np.sort(part)
        there = np.searchsorted(part, own, "right") - np.searchsorted(part, own, "left")
        return float((np.minimum(there, count) * w).sum() / (count * w).sum())


class Anchors:
    """Of each item so many of its shingles, those in the fewest items first, that they weigh more than the share 1 - `least`. A stretch of text
    that holds the share `least` of an item holds one of them, so looking these up finds every such stretch."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: float):
        h, s, e, at = words(data, offsets)
        sh, so = shingles(h, at, K)
        w = weights(e - s, at, so)
        self.ids, self.least, self.items, self.length = ids, least, [], []
        for i in range(ids.size):
            own, where, count = np.unique(sh[so[i] : so[i + 1]], return_index=True, return_counts=True)
            self.items.append((own, count, w[so[i] : so[i + 1]][where]))
            size = size_class(int(so[i + 1] - so[i])) if own.size else 0
            self.length.append(size + 2 * max(1, size // 7))
        every, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *(own for own, _, _ in self.items)]), return_counts=True)
        keys, members = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (own, count, weight) in enumerate(self.items):
            order = np.lexsort((-weight, held[np.searchsorted(every, own)]))
            share = np.cumsum((count * weight)[order])
            n = int(np.searchsorted(share, (1 - least + 1e-9) * share[-1], "right")) + 1 if own.size else 0
            keys.append(own[order[:n]])
            members.append(np.full(keys[-1].size, i))
        key, member = np.concatenate(keys), np.concatenate(members)
        order = np.argsort(key, kind="stable")
        self.members = member[order]
        self.keys, first = np.unique(key[order], return_index=True)
        self.start = np.append(first, key.size)
        self.some = np.zeros(1 << max(16, (8 * self.keys.size).bit_length()), bool)  # most shingles of a text are told apart by this alone
        self.some[self.keys & np.uint64(self.some.size - 1)] = True

    def hits(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of all anchors among shingles."""
        if not self.keys.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.some[sh & np.uint64(self.some.size - 1)])
        k = np.minimum(np.searchsorted(self.keys, sh[at]), self.keys.size - 1)
        ok = self.keys[k] == sh[at]
        at, k = at[ok], k[ok]
        n = self.start[k + 1] - self.start[k]
        return np.repeat(at, n), self.members[np.repeat(self.start[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def similarity(self, item: int, part: np.ndarray) -> float:
        """The greatest share of the item's weighted shingles, with multiplicity, that a stretch of `part` of the item's length and margins holds;
        0 if that is under `least`."""
        own, count, w = self.items[item]
        total = int((count * w).sum())
        k = np.minimum(np.searchsorted(own, part), own.size - 1)
        at = np.flatnonzero(own[k] == part)
        k = k[at]
        sums = np.concatenate([[0], np.cumsum(w[k])])
        if sums[-1] < self.least * total:
            return 0.0
        end = np.searchsorted(at, at + self.length[item])
        bound = sums[end] - sums[:-1]  # without regard to multiplicity
        best = 0
        for j in np.argsort(-bound, kind="stable").tolist():
            if bound[j] <= best or bound[j] < self.least * total or best == total:
                break
            best = max(best, int((np.minimum(np.bincount(k[j : end[j]], minlength=own.size), count) * w).sum()))
        return best / total if best / total >= self.least else 0.0


def _held(data: np.ndarray, offsets: np.ndarray, anchors: Anchors) -> dict[tuple[int, int], float]:
    """The best similarity of each (text, item) of which it is `least` or more."""
    h, _, _, at = words(data, offsets)
    sh, so = shingles(h, at, K)
    best: dict[tuple[int, int], float] = {}
    pos, item = anchors.hits(sh)
    text = np.searchsorted(so, pos, "right") - 1
    order = np.lexsort((pos, item, text))
    pos, item, text = pos[order], item[order], text[order]
    far = np.diff(pos) > 2 * np.array(anchors.length, np.int64)[item[1:]]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0) | far, [True]])) if pos.size else np.zeros(1, int)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        t, i = int(text[lo]), int(item[lo])
        s = anchors.similarity(i, sh[max(pos[lo] - anchors.length[i] + 1, so[t]) : min(pos[hi - 1] + anchors.length[i], so[t + 1])])
        if s > best.get((t, i), 0):
            best[t, i] = s
    return best


def _search(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch):
            best = _held(*text_buffer(b.column(1)), anchors)
            rows = pa.array([t for t, _ in best], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([int(anchors.ids[i]) for _, i in best], pa.int64()), pa.array(list(best.values()), pa.float64())], ["doc_id", "item_id", "similarity"])


#: Items to an index, which is broadcast (some KB an item). More items are searched by several indexes, each in its own pass.
ITEMS = 20_000


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity) of every document that holds a benchmark item.

    A document holds an item if at least the share `least` of the item's weighted shingles (pairs of words, weighing their bytes) lie in some
    window of about the item's size or its margin of a seventh, wherever it starts; all of those are found. The best similarity is given for
    each document and item.

    Null or empty texts, and null doc_ids or item_ids, never match. Repeated rows give one result. One-word items match only one-word texts. Windows of
    a document shorter than an item are the whole document. Empty tables give no rows. Other columns aren't read.
    """
    texts = lowered(docs).where("doc_id IS NOT NULL")
    found = None
    for shared in _shared_anchors(docs.sparkSession, benchmark, least, items):
        hits = texts.mapInArrow(lambda it, shared=shared: _search(it, shared.value), "doc_id long, item_id long, similarity double")
        found = hits if found is None else found.unionAll(hits)
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, items: int = ITEMS) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no benchmark item, as `contamination` finds them; each row is judged by its own text, in place.

    Null and empty texts hold none and stay; so do rows without a doc_id unless their text holds one. Repeated rows stay or go together. Columns may have any names.
    """
    out = docs.withColumn(hidden(docs, "low")[0], F.lower(F.col("text").cast("string"))).toDF(*(f"c{i}" for i in range(len(docs.columns) + 1)))  # names with dots don't pass
    for shared in _shared_anchors(docs.sparkSession, benchmark, least, items):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in pieces(batch, batch.schema.names[-1]):
                    held = {t for t, _ in _held(*text_buffer(b.column(b.num_columns - 1)), shared.value)}
                    yield b.filter(pa.array([t not in held for t in range(b.num_rows)], pa.bool_())) if held else b

        out = out.mapInArrow(clean, out.schema)
    return out.drop(out.columns[-1]).toDF(*docs.columns)


def _shared_anchors(spark: SparkSession, benchmark: DataFrame, least: float, items: int) -> Iterator[Broadcast]:
    """The items' anchors, broadcast, `items` or so at a time."""
    bound_batches(spark)
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    passes = max(1, -(-own.count() // items))
    for p in range(passes):
        part = own.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toPandas()
        yield spark.sparkContext.broadcast(Anchors(part["item_id"].to_numpy(np.int64), *text_buffer(pa.array(part["text"], pa.large_string())), least))
