"""Substring dedup by collinear chaining.

Seeds are the minimizers of each document's runs of `k` words. An occurrence of a seed is matched with the corpus's first, so every occurrence
outside the first's document has one match however many there are. The matches between two
documents are chained: a chain's score is its seeds' words less a cost in proportion to the gaps between them, and a Fenwick tree over positions in
the other document finds each match's best predecessor. Chains are aligned word by word, which bridges edits and extends their ends.
Passages of `least` words or more that align with one document are the result; those that overlap, whatever documents they are from, make one. Where only pieces
from several documents are as long together, a document that holds them all has seeds of two of them about as far apart: pairs of seeds that no
piece holds are matched with the first document that has the pair, and, where this one doesn't align, with every one that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Work, bound_batches, by_ids, hidden, mix, named, pieces, shared_dir, small_batches, text_buffer, units, words

_POS = np.uint64((1 << 24) - 1)
SLICE_BYTES = 6 << 20  # text whose seeds are held at a time
GAP_COST = 0.1  # for each word of either document between two seeds of a chain
MAX_GAP = 30  # beyond, a seed's words can't pay for the gap


def minimizers(h: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, position) of the least of every `window` successive runs of k words; a text with fewer runs has its least one."""
    runs = np.maximum(np.diff(offsets) - k + 1, 0)
    if not runs.sum():
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    text = np.repeat(np.arange(runs.size), runs)
    at = np.cumsum(runs) - runs
    first = offsets[text] + np.arange(text.size) - at[text]
    x = h[first]
    for j in range(1, k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[first + j]
    x = mix(x, 31)
    chosen = []
    for lo in range(0, x.size, 1 << 23):  # positions have 24 bits
        y = (x[lo : lo + (1 << 23) + window] & ~_POS) | np.arange(x[lo : lo + (1 << 23) + window].size, dtype=np.uint64)
        width = 1
        while width < window:
            step = min(width, window - width)
            y = np.minimum(y[: max(y.size - step, 0)], y[step:]) if y.size > step else y[:0]
            width += step
        starts = lo + np.arange(y.size)
        inside = text[starts] == text[np.minimum(starts + window - 1, x.size - 1)]
        chosen.append((y[inside] & _POS).astype(np.int64) + lo)
    few = np.flatnonzero((runs > 0) & (runs < window))
    for t in few:
        chosen.append(np.array([at[t] + int(np.argmin(x[at[t] : at[t] + runs[t]] & ~_POS))]))
    c = np.unique(np.concatenate(chosen))
    return x[c], text[c], first[c] - offsets[text[c]]


def _numbered(batch: pa.RecordBatch, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, document, position) of a batch in this order."""
    parts = []
    for b in pieces(batch):
        h, _, _, at = words(*text_buffer(b.column(1)))
        seed, text, pos = minimizers(h, at, k, window)
        parts.append((seed, np.asarray(b.column(0))[text], pos.astype(np.int32)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    seed, doc, pos = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((pos, doc, seed))
    seed, doc, pos = seed[order], doc[order], pos[order]
    again = np.zeros(seed.size, bool)  # text that repeats itself at once: its occurrences are numbered, so that each matches its like
    again[1:] = (seed[1:] == seed[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] - pos[:-1] <= 2 * window)
    if again.any():
        index = np.arange(seed.size)
        number = index - np.maximum.accumulate(np.where(again, 0, index))
        seed = np.where(again, mix(seed + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 33), seed)
        order = np.lexsort((pos, doc, seed))
        seed, doc, pos = seed[order], doc[order], pos[order]
    return seed, doc, pos


def _occurrences(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, most=SLICE_BYTES):
            seed, doc, pos = _numbered(part, k, window)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(doc), pa.array(pos)], ["key", "doc", "pos"])


def _seeds(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    """A slice's first occurrence of each seed, with the others, if there are any: the rows of a key are one of each slice at most."""
    for batch in batches:
        for part in pieces(batch, most=SLICE_BYTES):
            seed, doc, pos = _numbered(part, k, window)
            first = np.concatenate([[True], seed[1:] != seed[:-1]]) if seed.size else np.zeros(0, bool)
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, seed.size)) - 1
            others = pa.StructArray.from_arrays([pa.array(doc[~first]), pa.array(pos[~first])], ["b", "pb"])
            more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), others, mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([pa.array(seed[at].view(np.int64)), pa.array(doc[at]), pa.array(pos[at]), more], ["key", "b", "pb", "more"])


def chains(pb: np.ndarray, pa_: np.ndarray, k: int) -> list[list[int]]:
    """Disjoint chains of matches, best first; matches are in the order of (pb, pa_). Chains rise strictly in both documents."""
    n = pb.size
    diagonal = pb - pa_
    if n == 1 or ((diagonal == diagonal[0]).all() and (np.diff(pb) <= MAX_GAP).all() and (np.diff(pb) > 0).all()):
        return [list(range(n))]
    rank = np.unique(pa_, return_inverse=True)[1] + 1
    size = int(rank.max())
    best, who = [-1e18] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    b_, a_, r_ = pb.tolist(), pa_.tolist(), rank.tolist()
    waiting: list[int] = []
    for i in range(n):
        if i and b_[i] != b_[i - 1]:
            for j in waiting:  # only matches that lie before in b are in the tree
                v, r = score[j] + GAP_COST * (b_[j] + a_[j]), r_[j]
                while r <= size:
                    if v > best[r]:
                        best[r], who[r] = v, j
                    r += r & -r
            waiting.clear()
        r, top, j = r_[i] - 1, -1e18, -1
        while r:
            if best[r] > top:
                top, j = best[r], who[r]
            r -= r & -r
        gain = -1.0
        if j >= 0:
            gb, ga = b_[i] - b_[j], a_[i] - a_[j]
            new = min(k, gb, ga)  # overlapping seeds count their new words
            gain = top - GAP_COST * (b_[i] + a_[i]) - (k - new)
        score[i], back[i] = (k + gain, j) if gain > 0 else (float(k), -1)
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _chain(batches: Iterator[pa.RecordBatch], k: int, window: int, slack: int, least: int, alone: bool = False) -> Iterator[pa.RecordBatch]:
    """Chains of matches that come in the order of (b, a, pb, pa); only those in a stretch of b of about `least` words or more (or with `alone` of that
    length by themselves), and of these not those that lie within others in which at least 0.4 of the expected seeds match."""
    held: list[np.ndarray] = []

    def groups(m: np.ndarray) -> pa.RecordBatch:
        rows: list[tuple] = []
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(m[0]) != 0) | (np.diff(m[1]) != 0), [True]]))
        doc = None
        own: list[tuple] = []

        def flush() -> None:
            own.sort(key=lambda r: r[2])
            i = 0
            while i < len(own):  # stretches of chains that touch
                j, end = i + 1, own[i][3]
                while j < len(own) and own[j][2] <= end + slack:
                    end = max(end, own[j][3])
                    j += 1
                if end - own[i][2] >= least:
                    lo = own[i][2]
                    covered = np.zeros(end - lo, bool)
                    for r in sorted(own[i:j], key=lambda r: (r[2] - r[3], r[2], r[1])):
                        part = covered[r[2] - lo : r[3] - lo]
                        if not part.all():  # a chain within ones that are dense in seeds adds nothing
                            rows.append(r)
                            part |= r[5]
                i = j
            own.clear()

        for lo, hi in zip(cut[:-1], cut[1:]):
            b, a = int(m[0][lo]), int(m[1][lo])
            if b != doc:
                flush()
                doc = b
            pb, pa_ = m[2][lo:hi], m[3][lo:hi]
            for c in chains(pb, pa_, k):
                if alone and pb[c[-1]] + k - pb[c[0]] < least:
                    continue
                x, d = pb[c], pb[c] - pa_[c]
                turn = np.flatnonzero(np.diff(d)) + 1
                start, stop = np.append(0, turn), np.append(turn, len(c)) - 1
                own.append((b, a, int(x[0]), int(x[-1]) + k, np.stack([x[start], x[stop] + k, d[start]], 1).ravel().tolist(), len(c) * (window + 1) >= 0.8 * (int(x[-1]) + k - int(x[0]))))
        flush()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.list_(pa.int32()))], ["b", "a", "parts"])

    for batch in batches:
        m = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
        if not m.shape[1]:
            continue
        last = np.flatnonzero(m[0] != m[0][-1])
        end = int(last[-1]) + 1 if last.size else 0  # b's last matches may go on in the next batch
        if end:
            yield groups(np.concatenate([*held, m[:, :end]], axis=1))
            held = []
        elif held and held[-1][0][-1] != m[0][0]:
            yield groups(np.concatenate(held, axis=1))
            held = []
        held.append(m[:, end:])
    if held:
        yield groups(np.concatenate(held, axis=1))


def _gap_matches(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches of words."""
    if not x.size or not y.size:
        return 0
    row = np.zeros(y.size + 1, np.int64)
    for w in x:
        row[1:] = np.maximum.accumulate(np.where(y == w, row[:-1] + 1, row[1:]))
    return int(row[-1])


def align(hb: np.ndarray, ha: np.ndarray, parts: np.ndarray) -> tuple[int, int, float]:
    """First word and end in b of a chain's aligned passage, and its share of matching words.

    parts: (first word, end, diagonal) of the stretches on one diagonal. Stretches are compared word by word, what lies between two by common subsequence;
    the ends go on along their diagonal as long as that pays (1 for a match, -2 for a mismatch).
    """
    lo, hi, d = parts[:, 0].copy(), parts[:, 1].copy(), parts[:, 2]

    def extend(i: int, j: int, step: int) -> int:
        n = min(hb.size - i, ha.size - j) if step > 0 else min(i, j)
        if n <= 0:
            return 0
        at = 0
        total, best = 0, 0
        far = 0
        while at < n:  # in stretches of 64 words
            m = min(64, n - at)
            p = np.arange(at, at + m)
            eq = hb[i + p] == ha[j + p] if step > 0 else hb[i - 1 - p] == ha[j - 1 - p]
            s = total + np.cumsum(np.where(eq, 1, -2))
            top = int(np.argmax(s))
            if s[top] > best:
                best, far = int(s[top]), at + top + 1
            total = int(s[-1])
            if total < best - 16:
                break
            at += m
        return far

    lo[0] -= extend(int(lo[0]), int(lo[0] - d[0]), -1)
    hi[-1] += extend(int(hi[-1]), int(hi[-1] - d[-1]), 1)
    same, length = 0, 0
    for i in range(lo.size):
        s = lo[i] if not i else max(lo[i], hi[i - 1], hi[i - 1] - d[i - 1] + d[i])
        if i:
            x, y = hb[hi[i - 1] : s], ha[hi[i - 1] - d[i - 1] : s - d[i]]
            same += _gap_matches(x, y)
            length += max(x.size, y.size)
        if s < hi[i]:
            same += int((hb[s : hi[i]] == ha[s - d[i] : hi[i] - d[i]]).sum())
            length += int(hi[i] - s)
    return int(lo[0]), int(hi[-1]), same / max(length, 1)


def _align(batches: Iterator[pa.RecordBatch], identity: float) -> Iterator[pa.RecordBatch]:
    def hashed(ids: pa.Array, texts: pa.Array) -> tuple[tuple, np.ndarray, np.ndarray]:
        """Words and bytes of the different texts, and which of them each row has."""
        _, first, of = np.unique(np.asarray(ids), return_index=True, return_inverse=True)
        data, byte = text_buffer(texts.take(pa.array(first)))
        return words(data, byte), byte, of

    for batch in batches:
        for p in pieces(batch, "text_b"):
            col = lambda n: p.column(p.schema.get_field_index(n))  # noqa: B023, E731
            (hb, sb, eb, ob), byte, of_b = hashed(col("b"), col("text_b"))
            (ha, _, _, oa), _, of_a = hashed(col("a"), col("text_a"))
            rows = []
            for i, parts in enumerate(col("parts").to_pylist()):
                x = np.array(parts, np.int64).reshape(-1, 3)
                u, v = of_b[i], of_a[i]
                b, a = hb[ob[u] : ob[u + 1]], ha[oa[v] : oa[v + 1]]
                if x[-1, 1] > b.size or (x[:, 1] - x[:, 2] > a.size).any() or (x[:, 0] < x[:, 2]).any():
                    continue  # seeds of another text under the same doc_id
                s, e, share = align(b, a, x)
                if share >= identity:
                    rows.append((i, s, e, int(sb[ob[u] + s] - byte[u]), int(eb[ob[u] + e - 1] - byte[u])))
            r = np.array(rows, np.int64).reshape(-1, 5)
            take = pa.array(r[:, 0])
            yield pa.RecordBatch.from_arrays([col("b").take(take), col("a").take(take), col("hash_b").take(take), *(pa.array(r[:, j]) for j in range(1, 5))], ["b", "a", "hash", "first", "last", "byte_first", "byte_last"])


def _aligned(texts: DataFrame, chained: DataFrame, identity: float) -> DataFrame:
    """The aligned passage of every chain that reaches `identity`."""
    some = by_ids(texts, chained.select(F.explode(F.array("a", "b"))), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    pairs = chained.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    pairs = pairs.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("b", "a", "parts", "text_b", "text_a", F.xxhash64("text_b").alias("hash_b"))
    return pairs.mapInArrow(lambda it: _align(it, identity), "b long, a long, hash long, first long, last long, byte_first long, byte_last long")


#: Bytes of text that pairs may bring to one round of alignment, as a multiple of all texts', and at least.
ROUND_SHARE, ROUND_LEAST = 3.0, 1 << 28


def _rounds(texts: DataFrame, chained: DataFrame, work: Work, least: int = ROUND_LEAST) -> list[DataFrame]:
    """`chained` in parts by b. Every pair takes the text of its a along, and pairs become more faster than documents do; a part's texts are no more
    than about thrice all texts, so that the disk of a round follows the input."""
    size = work.table(texts.select(F.col("doc_id").alias("a"), F.octet_length("text").cast("long").alias("n")).groupBy("a").agg(F.max("n").alias("n")))
    whole = size.agg(F.sum("n")).first()[0] or 0
    taken = chained.join(size, "a").agg(F.sum("n")).first()[0] or 0
    n = -(-taken // max(int(ROUND_SHARE * whole), least))
    return [chained.where(F.pmod(F.xxhash64("b"), F.lit(n)) == i) for i in range(n)] if n > 1 else [chained]


def _islands(spans: DataFrame, slack: int) -> DataFrame:
    """`spans` with the number of the group of overlapping or touching ones of its document."""
    w = Window.partitionBy("b").orderBy("first", "last", "a")
    spans = spans.withColumn("reach", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return spans.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach") + slack), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _reach(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (b, at, ...) with `reach`, the farthest end of the spans (b, first, last) of b that begin at or before each of them; 0 if none does."""
    both = points.withColumn("_end", F.lit(None).cast("long")).unionByName(spans.select("b", F.col("first").alias("at"), F.col("last").alias("_end")), allowMissingColumns=True)
    w = Window.partitionBy("b").orderBy("at", F.col("_end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("reach", F.coalesce(F.max("_end").over(w), F.lit(0))).where("_end IS NULL").drop("_end")


def _loose(spans: DataFrame, least: int, slack: int) -> DataFrame:
    """(b, lo, hi) of the stretches of at least `least` words made of overlapping or touching passages some of which are in none that is as long by itself."""
    long = F.col("last") - F.col("first") >= least
    points = spans.where(~long).select("b", (F.col("first") + slack).alias("at"), "first", "last")
    short = _reach(points, spans.where(long)).where(F.col("reach") < F.col("last") - slack).select("b", "first")
    parts = _islands(spans, slack).groupBy("b", "island").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).where(F.col("hi") - F.col("lo") >= least)
    return parts.join(short, "b").where("first >= lo AND first < hi").select("b", "lo", "hi").distinct()


def _pairs(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Hashes of the pairs of seeds of one document that begin `low` to `high` words apart, if their bits are set (None: all).
    Rows (doc, pos, key, reach) come in the order of (doc, pos); pairs that end within the first one's reach are left out."""
    held: list[np.ndarray] = []

    def of(m: np.ndarray) -> Iterator[pa.RecordBatch]:
        turn = np.concatenate([[True], m[0][1:] != m[0][:-1]])
        place = m[1] + np.cumsum(turn) * (1 << 32)  # rises through all documents, which are far apart in it
        lo, hi = np.searchsorted(place, place + low), np.searchsorted(place, place + high, "right")
        n = np.maximum(hi - lo, 0)
        cut = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + 1_000_000, 1_000_000))
        for i, j in zip(cut[:-1], [*cut[1:-1], n.size]):
            one = np.repeat(np.arange(i, j), n[i:j])
            two = np.repeat(lo[i:j], n[i:j]) + np.arange(one.size) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
            ok = m[1][two] + k > m[3][one]
            one, two = one[ok], two[ok]
            key = mix(m[2][one].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + m[2][two].view(np.uint64), 35).view(np.int64)
            doc = m[0][one]
            if bits is not None:
                at = key & (8 * bits.size - 1)
                ok = (bits[at >> 3] >> (at & 7)) & 1 > 0
                key, doc = key[ok], doc[ok]
            if key.size:
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(key[new])], ["doc", "pair"])

    for batch in batches:
        m = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
        if not m.shape[1]:
            continue
        before = np.flatnonzero(m[0] != m[0][-1])
        end = int(before[-1]) + 1 if before.size else 0
        if end:
            yield from of(np.concatenate([*held, m[:, :end]], axis=1))
            held = []
        elif held and held[-1][0][-1] != m[0][0]:
            yield from of(np.concatenate(held, axis=1))
            held = []
        held.append(m[:, end:])
    if held:
        yield from of(np.concatenate(held, axis=1))


#: Bytes of the bitmap by which pairs that nobody asks for are left out before the shuffle; it is of one size for any number of pairs.
BITMAP = 1 << 23


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """The bits of all pairs: set in each task, and put together in pieces."""
    piece = BITMAP // 256

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP, np.uint8)
        for b in batches:
            at = np.unique(np.asarray(b.column(0)) & (8 * BITMAP - 1))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        some = np.flatnonzero(bits.reshape(256, -1).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([bits[i * piece : (i + 1) * piece].tobytes() for i in some], pa.binary())], ["i", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), np.uint8)
                held[i] = held[i] | x if i in held else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["i", "bits"])

    out = np.zeros(BITMAP, np.uint8)
    for r in pairs.select("pair").mapInArrow(mark, "i int, bits binary").repartition(32, "i").mapInArrow(merge, "i int, bits binary").toLocalIterator():
        out[r["i"] * piece : (r["i"] + 1) * piece] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _pairs_of(seeds: DataFrame, k: int, low: int, high: int, wanted: DataFrame | None = None) -> DataFrame:
    """(doc, pair) of the pairs of seeds, if they are in `wanted`, a written table."""
    rows = seeds.select("doc", "pos", "key", "reach").repartition("doc").sortWithinPartitions("doc", "pos")
    if wanted is None:
        return rows.mapInArrow(lambda it: _pairs(it, k, low, high, None), "doc long, pair long").distinct()
    shared = seeds.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    pairs = rows.mapInArrow(lambda it: _pairs(it, k, low, high, shared.value), "doc long, pair long").distinct()
    return pairs.join(wanted.select("pair").distinct(), "pair", "left_semi")


def repeated_passages(docs: DataFrame, least: int = 50, k: int = 6, window: int = 6, identity: float = 0.7, slack: int = 5) -> DataFrame:
    """(doc_id, first_word, end_word, first_byte, end_byte, source_id, text_hash) of passages that stand in a document of a lesser doc_id, too.

    source_id is the document that the longest part of the passage was found in; text_hash is the xxhash64 of the text that the offsets are of.
    The passage of the least doc_id is nowhere reported. Word for word copies of `least` words hold seeds in any case, being longer than
    k + window - 1; in fuzzy ones, stretches of k words must survive between edits, `identity` of the words, and no gap be over about 30 words.
    Passages that repeat only within their own document aren't reported. Words are compared regardless of ASCII case.

    Null or empty texts and those of fewer than k words have none. Rows with a null doc_id are left out; rows that repeat doc_id and text are one
    document; different texts under one doc_id are different documents, all but the least in order of which come after all others. An empty table gives no rows. Other columns
    aren't read. The result depends neither on the order of rows nor on how they fall into files, partitions or batches.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bound_batches(spark)
    work = Work(spark)
    texts, names = units(docs, work)
    seldom = max(window, least // 5)  # for pieces, fewer seeds will do
    near = max(k, min(2 * least // 5, least - 2 * (k + seldom - 1)))  # seeds may begin and end so much later and earlier than a passage
    chain = "b long, a long, parts array<int>"
    seeds = texts.mapInArrow(lambda it: _seeds(it, k, window), "key long, b long, pb int, more array<struct<b: long, pb: int>>")
    order = Window.partitionBy("key").orderBy("b", "pb")
    found = seeds.select("b", "pb", "more", F.first("b").over(order).alias("a"), F.first("pb").over(order).alias("pa")).where("a <> b OR more IS NOT NULL")
    every = F.concat(F.array(F.struct("b", "pb")), F.coalesce("more", F.array().cast("array<struct<b: long, pb: int>>")))
    found = found.select("a", "pa", F.explode(every).alias("_o")).select("a", "pa", "_o.b", "_o.pb").where("a <> b")
    found = found.repartition("b").sortWithinPartitions("b", "a", "pb", "pa").select("b", "a", "pb", "pa")
    chained = work.table(found.mapInArrow(lambda it: _chain(it, k, window, slack + 20, near), chain))
    with small_batches(spark):
        spans = work.tables(_aligned(texts, part, identity) for part in _rounds(texts, chained, work))

    # short pieces that only together are long enough: another document may hold all of them, and then has seeds of two pieces about as far apart
    parts = work.table(_loose(spans, least, slack))
    if not parts.isEmpty():
        asked = by_ids(texts, parts.select("b"), "left_semi").mapInArrow(lambda it: _occurrences(it, k, seldom), "key long, b long, at int")
        asked = work.table(asked.join(parts, "b").where(F.col("at").between(F.col("lo"), F.col("hi") - k)).select("key", "b", "at").distinct())
        there = work.table(by_ids(texts.mapInArrow(lambda it: _occurrences(it, k, seldom), "key long, doc long, pos int"), asked.select("key"), "left_semi", "key"))
        others = None
        while True:  # each pair's first document; then, for pairs that this one doesn't align with, all that have it
            own = _reach(asked, spans).withColumnRenamed("b", "doc").withColumnRenamed("at", "pos")
            own = work.table(_pairs_of(own, k, near, near + seldom + slack).select(F.col("doc").alias("b"), "pair"))
            first = others is None
            if first:
                others = work.table(_pairs_of(there.withColumn("reach", F.lit(0)), k, near - slack, near + seldom + 2 * slack, own).select("pair", F.col("doc").alias("a")))
            have = others.groupBy("pair").agg(F.min("a").alias("a")) if first else others
            links = work.table(own.join(have, "pair").where("a < b").select("b", "a").distinct())
            found = links.join(asked, "b").join(there.select("key", F.col("doc").alias("a"), F.col("pos").alias("pa")), ["key", "a"]).select("b", "a", F.col("at").alias("pb"), "pa")
            found = found.repartition("b").sortWithinPartitions("b", "a", "pb", "pa")
            chained = work.table(found.mapInArrow(lambda it: _chain(it, k, seldom, slack + 20, near, True), chain))
            with small_batches(spark):
                more = work.tables(_aligned(texts, part, identity) for part in _rounds(texts, chained, work))
                spans = work.table(spans.unionAll(more).distinct())
            parts = work.table(_loose(spans, least, slack)) if first else None
            if not first or parts.isEmpty():
                break
            asked = work.table(asked.join(parts, "b").where(F.col("at").between(F.col("lo"), F.col("hi") - k)).select("key", "b", "at").distinct())
    spans = _islands(spans.where(F.col("last") - F.col("first") >= least), slack)
    out = spans.groupBy("b", "island").agg(F.min("first").alias("first_word"), F.max("last").alias("end_word"), F.min("byte_first").alias("first_byte"), F.max("byte_last").alias("end_byte"), F.max_by("a", F.struct(F.col("last") - F.col("first"), -F.col("a"))).alias("source_id"), F.first("hash").alias("text_hash"))
    out = named(out.select(F.col("b").alias("doc_id"), "first_word", "end_word", "first_byte", "end_byte", "source_id", "text_hash"), names, "doc_id", "source_id").checkpoint()
    work.drop()
    return out


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The rows of `docs` with the passages cut out of their texts (a blank in their stead), and n_chars, if there is such a column, anew.

    Rows without passages stay as they are, nulls, empty texts and repeated rows included; those with no word left go. A passage is cut from every row with
    its doc_id and the very text that it was found in, whatever other rows share the doc_id. Columns of any other names stay as they are.
    """
    cuts_, id_, hash_, text_ = hidden(docs, "cuts", "id", "hash", "text")
    cuts = passages.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("first_byte", "end_byte")))).toDF(id_, hash_, cuts_)
    work = Work(docs.sparkSession)
    cuts = work.table(cuts).checkpoint()
    work.drop()
    n = cuts.count()
    whole = by_ids(docs, cuts.select(id_), "left_anti")
    some = by_ids(docs, cuts.select(id_), "left_semi")
    some = some.join(F.broadcast(cuts) if n <= 100_000 else cuts, (some["doc_id"] == cuts[id_]) & (F.xxhash64(some["text"].cast("string")) == cuts[hash_]), "left")
    raw = F.encode("text", "utf-8")
    bounds = F.concat(F.transform(cuts_, lambda c: c["first_byte"]), F.array(F.octet_length("text").cast("long")))
    kept = F.transform(bounds, lambda e, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.col(cuts_)[i - 1]["end_byte"]).cast("int").alias("s"), e.cast("int").alias("e")))
    pieces_ = F.transform(kept, lambda p: F.trim(F.decode(F.substring(raw, p["s"] + 1, p["e"] - p["s"]), "utf-8")))
    text = F.when(F.col(cuts_).isNull(), F.col("text")).otherwise(F.array_join(F.filter(pieces_, lambda p: F.length(p) > 0), " "))
    some = some.withColumn(text_, text).where(F.col(cuts_).isNull() | F.col(text_).rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
    columns = [F.col(text_).alias(c) if c == "text" else F.when(F.col(cuts_).isNull(), F.col(c)).otherwise(F.length(text_)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return whole.unionByName(some.select(*columns))
