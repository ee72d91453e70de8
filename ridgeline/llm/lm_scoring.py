"""Language-model scoring by cross-entropy difference.

A target model (documents labelled good) and a background model (all documents) are bigram models over one vocabulary, which is every word of the corpus:
P(w | h) = mix * c(h, w) / c(h) + (1 - mix) * (r c(w) + 1) / (r N + V). The background's words are weighed by r, the target's words over the background's, so that
both are smoothed as models of one size are (r is 1 for the target). A word that a model has itself counted at that place is taken out of its counts first.
A document's score is the mean over its words of the target's loss minus the background's; the lower, the more like the target.

Frequent words, which are a bounded number, are numbered and broadcast with their counts. A pair of two frequent words is counted and scored in the shard of the
pair, where the documents' words come as packed numbers. A pair whose second word is rare goes to the shard of that word, which has all of its occurrences and so
its counts; one whose first word is rare goes to that word's shard; what has two rare words is counted in the second one's shard and joined with the first one's counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import BROADCAST_IDS, Work, mix, pieces, shared_dir, text_buffer, words

_START = np.uint64(1)  # stands for the start of a text among the contexts
RARE, START = 0, 1
_RARE_BIT = np.uint64(1 << 63)  # set in a rare word's code, whose other bits are its hash; frequent words' codes are their numbers
_OTHER = np.uint64((1 << 63) - 1)  # any second word that is rare, too
FREQUENT, SECOND, FIRST, DONE = range(4)


@dataclass
class Vocabulary:
    names: np.ndarray  # sorted hashes of the frequent words; their numbers are 2, 3, ...
    counts: np.ndarray  # by number: in the background, in the target, as a context in the background, as one in the target
    total: np.ndarray  # words of the background and of the target
    kinds: int  # different words
    hot: np.ndarray  # sorted keys of the pairs that are too many for one shard
    hot_counts: np.ndarray  # of these, in the background and in the target

    def numbers(self, h: np.ndarray) -> np.ndarray:
        own, at = np.unique(h, return_inverse=True)
        p = np.minimum(np.searchsorted(self.names, own), max(self.names.size - 1, 0))
        known = self.names[p] == own if self.names.size else np.zeros(own.size, bool)
        return np.where(known, p + 2, RARE)[at]

    def log_p(self, j: int, taken: np.ndarray | int, pair: np.ndarray, context: np.ndarray, word: np.ndarray, weight: float) -> np.ndarray:
        """Log-probabilities by the background (j = 0) or the target (j = 1) from the counts of pair, context and word."""
        r = self.total[1] / self.total[0] if j == 0 and self.total[1] else 1.0
        p2 = np.where(context - taken > 0, (pair - taken) / np.maximum(context - taken, 1), 0)
        return np.log(np.maximum(weight * p2 + (1 - weight) * (r * (word - taken) + 1) / (r * (self.total[j] - taken) + self.kinds), 1e-300))

    def losses(self, t: np.ndarray, pair: np.ndarray, context: np.ndarray, word: np.ndarray, weight: float) -> np.ndarray:
        """The target's loss minus the background's for words of documents of the target (t = 1) and others; counts have a column for each model."""
        return self.log_p(0, 1, pair[:, 0], context[:, 0], word[:, 0], weight) - self.log_p(1, t, pair[:, 1], context[:, 1], word[:, 1], weight)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.zeros(0, int)
    return h[first], np.add.reduceat(c, first, axis=0) if first.size else c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for b in pieces(batch):
            h, _, _, at = words(*text_buffer(b.column(1)))
            n = np.diff(at)
            target = np.asarray(b.column(2)).astype(np.int64)
            t = np.repeat(target, n)
            inner = np.ones(h.size, np.int64)
            inner[at[1:][n > 0] - 1] = 0
            order = np.argsort(h)
            x = h[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if x.size else np.zeros(0, int)
            c = np.stack([np.add.reduceat(y[order], first) if first.size else first for y in (np.ones_like(t), t, inner, inner * t)], 1)
            parts.append((np.append(x[first], _START), np.vstack([c, [[0, 0, (n > 0).sum(), target[n > 0].sum()]]])))
            size += first.size
            if size > 1_500_000:
                parts = [_merge(parts)]
                if parts[0][0].size > 1_000_000:
                    yield _rows(*parts.pop())
                size = sum(p[0].size for p in parts)
    if parts:
        yield _rows(*_merge(parts))


def _rows(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(c[:, j]) for j in range(4))], ["h", "c", "ct", "x", "xt"])


def _hot(batches: Iterator[pa.RecordBatch], v: Vocabulary, some: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of two of the words numbered in `some`."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for b in pieces(batch):
            h, before, w, n, at = _numbered(b, v)
            t = np.repeat(np.asarray(b.column(2)).astype(np.int64), n)
            ok = some[w] & some[before]
            key, index, c = np.unique(before[ok] * np.int64(len(v.counts)) + w[ok], return_inverse=True, return_counts=True)
            parts.append((key, np.stack([c, np.bincount(index, weights=t[ok], minlength=key.size).astype(np.int64)], 1)))
            if sum(p[0].size for p in parts) > 1_000_000:
                parts = [_merge(parts)]
    key, c = _merge(parts) if parts else (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c[:, 0]), pa.array(c[:, 1])], ["key", "c", "ct"])


def vocabulary(texts: DataFrame, work: Work, min_share: float, most: int) -> Vocabulary:
    """Words of at least `min_share` of all, 1 / min_share at most, with their counts, and the pairs that occur more than `most` times."""
    counted = work.table(texts.mapInArrow(_count, "h long, c long, ct long, x long, xt long").groupBy("h").agg(*(F.sum(k).alias(k) for k in ("c", "ct", "x", "xt"))))
    start = F.col("h") == int(_START)
    *total, kinds = counted.where(~start).agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("c", "ct")), F.count("*")).first()
    rows = counted.where(start | (F.col("c") >= min_share * float(total[0]))).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    c = rows[["c", "ct", "x", "xt"]].to_numpy(np.int64)
    is_start = h == _START
    order = np.argsort(h[~is_start])
    none = np.zeros(0, np.int64)
    v = Vocabulary(h[~is_start][order], np.vstack([np.zeros((1, 4), np.int64), c[is_start].sum(axis=0)[None], c[~is_start][order]]), np.array(total, np.int64), int(kinds), none, none.reshape(0, 2))
    some = (v.counts[:, 0] > most) | (v.counts[:, 2] > most)
    if some.any():
        shared = texts.sparkSession.sparkContext.broadcast((v, some))
        pairs = texts.mapInArrow(lambda it: _hot(it, *shared.value), "key long, c long, ct long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("ct").alias("ct")).where(F.col("c") > most).orderBy("key").toPandas()
        v.hot, v.hot_counts = pairs["key"].to_numpy(np.int64), pairs[["c", "ct"]].to_numpy(np.int64).reshape(-1, 2)
    return v


def _numbered(b: pa.RecordBatch, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a batch's words, the number of the word before each, its own, and the texts' numbers of words and offsets."""
    h, _, _, at = words(*text_buffer(b.column(1)))
    n = np.diff(at)
    w = v.numbers(h).astype(np.int64)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[at[:-1][n > 0]] = START
    return h, before, w, n, at


def _binary(data: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Rows of a binary column: rows cut[i] to cut[i + 1] of an array."""
    flat = np.ascontiguousarray(data)
    size = flat.itemsize * (flat.shape[1] if flat.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), cut.size - 1, [None, pa.py_buffer((cut * size).astype(np.int32)), pa.py_buffer(flat.reshape(-1).view(np.uint8))])


_PACKET = "shard int, ids binary, target binary, many binary, keys binary"


def _packed(shard: np.ndarray, doc: np.ndarray, raw: np.ndarray, ids: np.ndarray, target: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard: the documents with words there, how many, and the words' keys."""
    if not shard.size:
        return
    order = np.argsort(shard, kind="stable")
    shard, doc, raw = shard[order], doc[order], raw[order]
    first = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1])]))
    many = np.diff(np.append(first, shard.size)).astype("<i4")
    own = np.flatnonzero(np.concatenate([[True], np.diff(shard[first]) != 0]))
    docs = np.append(own, first.size)
    columns = [_binary(ids[doc[first]], docs), _binary(target[doc[first]], docs), _binary(many, docs), _binary(raw, np.append(first[own], shard.size))]
    yield pa.RecordBatch.from_arrays([pa.array(shard[first][own].astype(np.int32)), *columns], ["shard", "ids", "target", "many", "keys"])


def _packets(batches: Iterator[pa.RecordBatch], v: Vocabulary, shards: int, width: int, weight: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch):
            h, before, w, n, at = _numbered(b, v)
            ids, target = np.asarray(b.column(0)).astype("<i8"), np.asarray(b.column(2)).astype(np.uint8)
            doc = np.repeat(np.arange(n.size), n)
            rare = w == RARE
            code = np.where(rare, h | _RARE_BIT, w.astype(np.uint64))
            behind = np.empty_like(code)
            behind[1:] = code[:-1]
            behind[at[:-1][n > 0]] = START
            rare_before = before == RARE
            both = ~rare & ~rare_before
            key = before[both] * np.int64(len(v.counts)) + w[both]
            p = np.minimum(np.searchsorted(v.hot, key), max(v.hot.size - 1, 0))
            hot = v.hot[p] == key if v.hot.size else np.zeros(key.size, bool)
            raw = key[~hot].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
            yield from _packed((mix(key[~hot], 21) % np.uint64(shards)).astype(np.int64), doc[both][~hot], raw, ids, target)
            pair = lambda ok, other: np.stack([code[ok], other], 1).astype("<u8").view(np.uint8)  # noqa: B023, E731
            yield from _packed(SECOND * shards + (mix(code[rare], 22) % np.uint64(shards)).astype(np.int64), doc[rare], pair(rare, behind[rare]), ids, target)
            of = np.where(rare, _OTHER, code)[rare_before]
            context = np.stack([behind[rare_before], of], 1).astype("<u8").view(np.uint8)
            yield from _packed(FIRST * shards + (mix(behind[rare_before], 22) % np.uint64(shards)).astype(np.int64), doc[rare_before], context, ids, target)
            # what is scored at once: pairs whose counts are here, and texts without words, so that every document has a row
            own, q = doc[both][hot], p[hot]
            loss = v.losses(target[own].astype(np.int64), v.hot_counts[q], v.counts[before[both][hot], 2:], v.counts[w[both][hot], :2], weight) if q.size else np.zeros(0)
            done = np.flatnonzero((np.bincount(own, minlength=n.size) > 0) | (n == 0))
            sums = np.stack([np.bincount(own, weights=loss, minlength=n.size)[done], np.bincount(own, minlength=n.size)[done].astype(float)], 1).astype("<f8").view(np.uint8)
            if done.size:
                yield from _packed(np.full(done.size, DONE * shards + int(mix(ids[:1], 23)[0] % np.uint64(shards))), done, sums, ids, target)


_SCORED = "doc_id long, loss double, n long, h long, t long, pair_0 long, pair_1 long, word_0 long, word_1 long, context_0 long, context_1 long"


def _scored(shard: int, table: pa.Table, v: Vocabulary, shards: int, width: int, weight: float) -> pa.Table:
    """What a shard has found out: a loss and its number of words for each document; of pairs of rare words, all but the first one's counts, which others have as rows without a document."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    ids, target, many, raw = join("ids", "<i8"), join("target", np.uint8).astype(np.int64), join("many", "<i4"), join("keys", np.uint8)
    kind, doc = shard // shards, np.repeat(np.arange(ids.size), many)
    t = target[doc]
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def rows(**given: np.ndarray) -> pa.Table:
        size = len(next(iter(given.values())))
        types = {"loss": pa.float64()}
        return pa.table({k: pa.array(given[k]) if k in given else pa.nulls(size, types.get(k, pa.int64())) for k in names})

    def by_doc(ok: np.ndarray, loss: np.ndarray) -> pa.Table:
        n = np.bincount(doc[ok], minlength=ids.size)
        some = n > 0
        return rows(doc_id=ids[some], loss=np.bincount(doc[ok], weights=loss, minlength=ids.size).astype(float)[some], n=n[some])

    def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at, c = np.unique(key, return_inverse=True, return_counts=True)
        return at, np.stack([c, np.bincount(at, weights=t, minlength=own.size).astype(np.int64)], 1)

    if kind == DONE:
        x = raw.view("<f8").reshape(-1, 2)
        return rows(doc_id=ids, loss=x[:, 0].copy(), n=x[:, 1].astype(np.int64))
    if kind == FREQUENT:
        full = np.zeros((raw.size // width, 8), np.uint8)
        full[:, :width] = raw.reshape(-1, width)
        key = full.view("<i8")[:, 0]
        own, at, c = np.unique(key, return_inverse=True, return_counts=True)
        pair = np.stack([c, np.bincount(at, weights=t, minlength=own.size).astype(np.int64)], 1)
        before, w = np.divmod(own, len(v.counts))
        each = np.stack([v.losses(np.int64(k), np.maximum(pair, [[1, k]]), v.counts[before, 2:], v.counts[w, :2], weight) for k in (0, 1)], 1)
        return by_doc(np.ones(doc.size, bool), each[at, t])
    code = raw.view("<u8").reshape(-1, 2)
    at, of_code = counted(code[:, 0])
    pair_at, of_pair = counted(mix(code[:, 0], 24) ^ mix(code[:, 1], 25))
    ok = (code[:, 1] & _RARE_BIT) == 0 if kind == SECOND else code[:, 1] != _OTHER
    number = code[ok, 1].astype(np.int64)
    if kind == SECOND:  # words that come after a frequent one; after a rare one, its counts are wanting
        done = by_doc(ok, v.losses(t[ok], of_pair[pair_at[ok]], v.counts[number, 2:], of_code[at[ok]], weight))
        x = ~ok
        p, w = of_pair[pair_at[x]], of_code[at[x]]
        left = rows(doc_id=ids[doc[x]], n=np.ones(int(x.sum()), np.int64), h=code[x, 1].view("<i8"), t=t[x], pair_0=p[:, 0], pair_1=p[:, 1], word_0=w[:, 0], word_1=w[:, 1])
    else:
        done = by_doc(ok, v.losses(t[ok], of_pair[pair_at[ok]], of_code[at[ok]], v.counts[number, :2], weight))
        h, first = np.unique(code[~ok, 0], return_index=True)
        c = of_code[at[np.flatnonzero(~ok)[first]]]
        left = rows(h=h.view("<i8"), context_0=c[:, 0], context_1=c[:, 1])
    return pa.concat_tables([done, left])


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, min_share: float = 5e-7, weight: float = 0.5, shard_words: int = 2_000_000, hot_pairs: int = 8_000_000) -> DataFrame:
    """(doc_id, n_words, score) of every document.

    Every word and pair of words is counted over all documents. min_share: words of a lesser share are rare, which has no influence on the result but only on the
    way that they are counted. Shards hold `shard_words` words on average, so that there are more of them the larger the corpus; pairs that occur more than
    `hot_pairs` times are counted by partial sums, are broadcast (there are a bounded share of them) and scored where they stand.

    Null or empty texts have 0 words and a null score. Rows with a null doc_id are left out. Rows that repeat a doc_id make up one
    document. Without labels the target model is uniform. Labels with nulls count as not good; of several, all must be good. Texts may have any length.
    An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    work = Work(spark)
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("good_id")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("ok")).where("ok").select("good_id")
    n_good = good.count()
    good = F.broadcast(good) if n_good <= BROADCAST_IDS else good
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    texts = texts.join(good, texts.doc_id == good.good_id, "left").select("doc_id", "text", F.when(F.col("good_id").isNotNull(), 1).otherwise(0).cast("byte").alias("target"))
    v = vocabulary(texts, work, min_share, hot_pairs)
    shards = max(1, -(-int(v.total[0]) // shard_words))
    width = max(1, -(-int(len(v.counts) ** 2 - 1).bit_length() // 8))
    shared = spark.sparkContext.broadcast(v)
    packets = texts.mapInArrow(lambda it: _packets(it, shared.value, shards, width, weight), _PACKET)
    scored = work.table(packets.groupBy("shard").applyInArrow(lambda key, t: _scored(key[0].as_py(), t, shared.value, shards, width, weight), _SCORED))
    left = scored.where("loss IS NULL AND doc_id IS NOT NULL").drop("loss", "context_0", "context_1")
    known = scored.where("doc_id IS NULL").select("h", "context_0", "context_1")
    n, nt = float(v.total[0]), float(v.total[1])
    r = nt / n if nt else 1.0

    def p(j: int, taken: str, r: float, total: float) -> str:
        return f"ln({weight} * CASE WHEN context_{j} - {taken} > 0 THEN (pair_{j} - {taken}) / (context_{j} - {taken}) ELSE 0D END + (1 - {weight}) * ({r!r}D * (word_{j} - {taken}) + 1) / ({r!r}D * ({total!r}D - {taken}) + {v.kinds}))"

    more = left.join(known, "h").select("doc_id", F.expr(f"{p(0, '1', r, n)} - {p(1, 't', 1.0, nt)}").alias("loss"), "n")
    losses = scored.where("loss IS NOT NULL").select("doc_id", "loss", "n").unionAll(more)
    out = losses.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.round(F.sum("loss") / F.when(F.sum("n") > 0, F.sum("n")), 6).alias("score")).checkpoint()
    work.drop()
    return out


def cross_entropy_difference_sql(weight: float = 0.5) -> str:
    """The same in DuckDB's SQL over tables documents and labels."""
    return f"""
WITH good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING bool_and(coalesce(quality = 1 AND toxic = 0, false))),
d AS (SELECT row_number() OVER () AS r, doc_id, (doc_id IN (SELECT doc_id FROM good))::INT AS t, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
tok AS (SELECT r, doc_id, t, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM d),
tot AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(t), 0)::DOUBLE AS nt, CASE WHEN sum(t) > 0 THEN sum(t) / count(*) ELSE 1 END AS rate FROM tok),
big AS (SELECT doc_id, t, coalesce(lag(w) OVER (PARTITION BY r ORDER BY p), '') AS h, w FROM tok),
uni AS (SELECT w, count(*)::DOUBLE AS c, sum(t)::DOUBLE AS ct FROM big GROUP BY w),
ctx AS (SELECT h, count(*)::DOUBLE AS x, sum(t)::DOUBLE AS xt FROM big GROUP BY h),
par AS (SELECT h, w, count(*)::DOUBLE AS b, sum(t)::DOUBLE AS bt FROM big GROUP BY h, w),
v AS (SELECT count(*)::DOUBLE AS k FROM uni),
loss AS (SELECT doc_id,
  ln({weight} * CASE WHEN x > 1 THEN (b - 1) / (x - 1) ELSE 0 END + (1 - {weight}) * (rate * (c - 1) + 1) / (rate * (n - 1) + k))
  - ln({weight} * CASE WHEN xt - t > 0 THEN (bt - t) / (xt - t) ELSE 0 END + (1 - {weight}) * (ct - t + 1) / (nt - t + k)) AS loss
  FROM big JOIN uni USING (w) JOIN ctx USING (h) JOIN par USING (h, w), tot, v)
SELECT doc_id, coalesce(n, 0) AS n_words, round(s / n, 6) AS score
FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN (SELECT doc_id, count(*) AS n, sum(loss) AS s FROM loss GROUP BY doc_id) USING (doc_id)"""
