"""Decisions from scores: the F-measure sweep, multi-label thresholds, argmax, and span decisions with a calibrated rejection.

Predictions are (row, label, score); expected labels (row, label). Ties of score are ordered by row and label wherever an order decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.containers import ranked

INF = float("inf")


def sweep(pool: DataFrame, expected: int, order: tuple[str, ...] = ("row", "label")) -> dict[str, float]:
    """The cut of a pool (score, hit, order columns) that has the best F1, taking rows by falling score: f1, precision, recall, k, threshold.

    The first of equal cuts counts. The threshold is halfway between the last score taken and the next, or the last score of all; with
    nothing to take, infinity. Scores that tie are not taken together.
    """
    x = pool.withColumns({"_d": -F.col("score").cast("double"), "_h": F.col("hit").cast("long")})
    r = ranked(x, "_k", ["_d", *order], sums={"_tp": "_h"})
    f1 = 2.0 * F.col("_tp") / (F.col("_k") + 1 + expected)
    best = r.select(f1.alias("f1"), "_k", "_tp", F.col("score").cast("double").alias("score")).where("f1 > 0").agg(F.max_by(F.struct("f1", "_k", "_tp", "score"), F.struct("f1", -F.col("_k"))).alias("b")).first()["b"]
    if best is None:
        return {"f1": 0.0, "precision": 0.0, "recall": 0.0, "k": 0, "threshold": INF}
    after = r.where(F.col("_k") == best["_k"] + 1).select(F.col("score").cast("double")).first()
    k, tp = int(best["_k"]) + 1, int(best["_tp"])
    return {"f1": best["f1"], "precision": tp / k, "recall": tp / expected if expected else 0.0, "k": k, "threshold": (best["score"] + after[0]) / 2 if after else best["score"]}


def with_hits(pred: DataFrame, expected: DataFrame) -> DataFrame:
    gold = expected.select("row", "label").distinct().withColumn("_g", F.lit(1))
    return pred.join(gold, ["row", "label"], "left").withColumn("hit", F.coalesce("_g", F.lit(0))).drop("_g")


@dataclass(frozen=True)
class Decider:
    """mode: multi (scores at the threshold or above), single (the best score), span (candidates that beat rejection, without overlap)."""

    n_labels: int
    mode: str = "multi"
    reject: int | None = None
    offset: float | None = None

    def __post_init__(self):
        if self.mode not in ("multi", "single", "span"):
            raise ValueError(f"no mode {self.mode}")
        if self.n_labels < 1:
            raise ValueError("at least one label")

    @property
    def threshold(self) -> float:
        return INF if self.offset is None else self.offset

    @property
    def reject_label(self) -> int:
        return self.n_labels - 1 if self.reject is None else self.reject

    # --- calibration ---

    def calibrated(self, scores: DataFrame, expected: DataFrame | None = None, cand: DataFrame | None = None, gold: DataFrame | None = None) -> tuple["Decider", dict]:
        """A decider with the offset that is best on these scores, and its metrics."""
        if self.mode == "single":
            return replace(self, offset=0.0), self.score(scores, expected)
        if self.mode == "multi":
            valid = scores.where(F.col("label").between(0, self.n_labels - 1))
            m = sweep(with_hits(valid, expected), expected.count())
            return replace(self, offset=m["threshold"]), m
        theta = span_offset(span_margins(scores, self.n_labels, self.reject_label), cand, gold)
        best = replace(self, offset=theta)
        return best, best.score(scores, None, cand, gold)

    # --- decisions ---

    def predict(self, scores: DataFrame, cand: DataFrame | None = None) -> DataFrame:
        """multi: (row, k), how many of a row's scores count; single: (row, label); span: (doc_id, s, e, ty)."""
        if self.mode == "single":
            return argmax(scores)
        if self.mode == "multi":
            ok = (F.col("score") >= self.threshold) & F.col("label").between(0, self.n_labels - 1)
            return scores.groupBy("row").agg(F.count_if(ok).alias("k"))
        return decode(span_margins(scores, self.n_labels, self.reject_label), cand, self.offset or 0.0)

    def score(self, scores: DataFrame, expected: DataFrame | None = None, cand: DataFrame | None = None, gold: DataFrame | None = None, strict: bool = True) -> dict[str, float]:
        if self.mode == "single":
            return single_metrics(argmax(scores), expected, self.n_labels)
        if self.mode == "multi":
            return multi_metrics(scores, expected, self.threshold, strict)
        return span_metrics(self.predict(scores, cand), gold)


def argmax(scores: DataFrame) -> DataFrame:
    """(row, label): the label of the best score, the least one of equals."""
    return scores.groupBy("row").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(row, rank, label, score): the k best scores of each row, by score, then label."""
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "label"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


# --- metrics ---------------------------------------------------------------------------------------------------------


def single_metrics(pred: DataFrame, expected: DataFrame, n_labels: int) -> dict[str, float]:
    """Mean F1 over all labels (0 for those that never occur) and accuracy over labelled rows; a row's first label is the one expected.
    Predictions of unlabelled rows count as predictions of their label."""
    gold = expected.groupBy("row").agg(F.min("label").alias("gold"))
    x = pred.join(gold, "row", "full").select("label", "gold", (F.col("label") == F.col("gold")).alias("hit"))
    both = x.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("p"), F.lit(0).alias("g"), F.col("hit")), F.struct(F.col("gold").alias("c"), F.lit(0).alias("p"), F.lit(1).alias("g"), F.lit(False).alias("hit")))).alias("z")).select("z.*").where(F.col("c").between(0, n_labels - 1))
    per = both.groupBy("c").agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.count_if("hit").alias("tp"))
    r = per.agg(F.sum(2.0 * F.col("tp") / (F.col("p") + F.col("g"))).alias("f"), F.sum("tp").alias("tp"), F.sum("g").alias("n")).first()
    return {"macro_f1": (r["f"] or 0.0) / n_labels, "accuracy": (r["tp"] or 0) / r["n"] if r["n"] else 0.0}


def multi_metrics(pred: DataFrame, expected: DataFrame, threshold: float, strict: bool = True) -> dict[str, float]:
    """Micro precision, recall and F1 at a threshold. strict: rows without any prediction are left out altogether, with what is expected of them;
    otherwise they count as missed."""
    gold = expected.select("row", "label").distinct()
    if strict:
        gold = gold.join(pred.select("row").distinct(), "row", "left_semi")
    kept = with_hits(pred.where(F.col("score") >= threshold), expected).agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("tp")).first()
    return prf(int(kept["tp"]), int(kept["n"]), gold.count())


def span_metrics(pred: DataFrame, gold: DataFrame) -> dict[str, float]:
    """Precision, recall and F1 of spans that agree in document, bounds and type."""
    on = ["doc_id", "s", "e", "ty"]
    p, g = pred.select(on).distinct(), gold.select(on).distinct()
    return prf(p.join(g, on, "left_semi").count(), p.count(), g.count())


def prf(tp: int, n: int, expected: int) -> dict[str, float]:
    return {"f1": 2.0 * tp / (n + expected) if tp else 0.0, "precision": tp / n if n else 0.0, "recall": tp / expected if expected else 0.0}


def regression_metrics(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """One row: total, mean, min, max and sample standard deviation of the absolute errors, and nmae, their mean over the expected mean (0 if that isn't positive)."""
    e = F.abs(F.col(predicted) - F.col(expected))
    mean = F.avg(expected)
    return df.agg(F.sum(e).alias("total"), F.avg(e).alias("mean"), F.min(e).alias("min"), F.max(e).alias("max"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("std"), F.when(mean > 0, F.avg(e) / mean).otherwise(0.0).alias("nmae"))


# --- spans -----------------------------------------------------------------------------------------------------------


def span_margins(scores: DataFrame, n_labels: int, reject: int) -> DataFrame:
    """(row, ty, best, second, rejected): of each candidate the best label other than rejection, its score and the next one's, and rejection's.
    With one label, there is nothing else: rejection is at 0."""
    if n_labels == 1:
        return scores.select("row", F.lit(0).alias("ty"), F.col("score").cast("double").alias("best"), F.lit(None).cast("double").alias("second"), F.lit(0.0).alias("rejected"))
    rank = F.row_number().over(Window.partitionBy("row", F.col("label") == reject).orderBy(F.desc("score"), "label"))
    x = scores.withColumn("_r", rank)
    own = F.col("label") != reject
    return x.groupBy("row").agg(F.max(F.when(own & (F.col("_r") == 1), F.col("label"))).alias("ty"), F.max(F.when(own & (F.col("_r") == 1), F.col("score").cast("double"))).alias("best"), F.max(F.when(own & (F.col("_r") == 2), F.col("score").cast("double"))).alias("second"), F.max(F.when(~own, F.col("score").cast("double"))).alias("rejected"))


def span_weights(margins: DataFrame, theta: float) -> DataFrame:
    """(row, ty, weight) of candidates that beat rejection less theta: the margin between the best and the next of all labels."""
    r = F.col("rejected") - theta
    return margins.withColumn("weight", F.col("best") - F.greatest(F.coalesce("second", r), r)).where(F.col("best") > r).select("row", "ty", "weight")


def decode(margins: DataFrame, cand: DataFrame, theta: float) -> DataFrame:
    """(doc_id, s, e, ty): the kept candidates without overlap. cand: (row, doc_id, s, e)."""
    return nms(cand.select("row", "doc_id", "s", "e").join(span_weights(margins, theta), "row"))


def schedule(s: np.ndarray, e: np.ndarray, w: np.ndarray) -> list[int]:
    """The intervals without overlap (those that touch don't) whose weights have the greatest sum; of equals, the fewest from the end."""
    order = np.lexsort((s, e))
    end = e[order]
    n = order.size
    before = np.minimum(np.searchsorted(end, s[order], "right"), np.arange(n)).tolist()
    best, top = [0.0], 0.0
    for j, gain in zip(before, np.asarray(w, float)[order].tolist()):
        top = max(top, best[j] + gain)
        best.append(top)
    out, i = [], n
    while i:
        j = before[i - 1]
        if best[i] == best[i - 1]:
            i -= 1
        else:
            out.append(int(order[i - 1]))
            i = j
    return out[::-1]


def nms(x: DataFrame) -> DataFrame:
    """(doc_id, s, e, ty) of each document's best set of spans (doc_id, s, e, ty, weight) by weighted interval scheduling."""
    kind = dict(x.dtypes)["doc_id"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("s", "ascending"), ("e", "ascending"), ("ty", "ascending")])
        keep = schedule(*(t.column(c).to_numpy() for c in ("s", "e", "weight")))
        return t.select(["doc_id", "s", "e", "ty"]).take(pa.array(keep, pa.int64()))

    x = x.select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.col("ty").cast("int").alias("ty"), F.col("weight").cast("double").alias("weight"))
    return x.groupBy("doc_id").applyInArrow(run, f"doc_id {kind}, s long, e long, ty int")


def _steps(t: pa.Table) -> pa.Table:
    """(theta, d_tp, d_pred): how a document's counts change at each of its breakpoints."""
    s, e = (t.column(c).to_numpy() for c in ("s", "e"))
    best = t.column("best").to_numpy(zero_copy_only=False)
    second = t.column("second").to_numpy(zero_copy_only=False).astype(float)
    rejected = t.column("rejected").to_numpy(zero_copy_only=False)
    hit = t.column("hit").to_numpy()
    at, (tp, pred) = np.unique(rejected - best), _decoded(s, e, best, second, rejected, hit)
    d_tp, d_pred = np.diff(tp, prepend=0), np.diff(pred, prepend=0)
    new = (d_tp != 0) | (d_pred != 0)
    return pa.table({"theta": pa.array(at[new], pa.float64()), "d_tp": pa.array(d_tp[new], pa.int64()), "d_pred": pa.array(d_pred[new], pa.int64())})


#: Candidates times offsets that are decoded at a time.
CELLS = 1 << 23


def _decoded(s: np.ndarray, e: np.ndarray, best: np.ndarray, second: np.ndarray, rejected: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits and spans among what `schedule` chooses just above each of a document's breakpoints. Weights change with the offset, so every candidate is looked
    at for each of them: all offsets of a block at once, candidate by candidate, with the counts of the choice carried along."""
    order = np.lexsort((s, e))
    n = order.size
    before = np.minimum(np.searchsorted(e[order], s[order], "right"), np.arange(n)).tolist()
    best, second, rejected, hit = best[order], second[order], rejected[order], hit[order].tolist()
    at = np.unique(rejected - best)
    point = (rejected - best).tolist()
    out: tuple[list, list] = ([], [])
    for lo in range(0, at.size, step := max(1, CELLS // (n + 1))):
        own = at[lo : lo + step]
        theta = np.nextafter(own, INF)
        first = np.searchsorted(own, point).tolist()
        top, tp, pred = (np.zeros((n + 1, own.size), kind) for kind in (float, np.int32, np.int32))
        for i, (j, k) in enumerate(zip(before, first)):
            top[i + 1], tp[i + 1], pred[i + 1] = top[i], tp[i], pred[i]
            if k < own.size:
                new = top[j, k:] + np.maximum(best[i] - np.fmax(second[i], rejected[i] - theta[k:]), 1e-300)
                taken = new > top[i, k:]
                np.copyto(top[i + 1, k:], new, where=taken)
                np.copyto(tp[i + 1, k:], tp[j, k:] + hit[i], where=taken, casting="unsafe")
                np.copyto(pred[i + 1, k:], pred[j, k:] + 1, where=taken)
        out[0].append(tp[n].astype(np.int64))
        out[1].append(pred[n].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def span_offset(margins: DataFrame, cand: DataFrame, gold: DataFrame) -> float:
    """The rejection offset with the best F1 (the first of equals; halfway to the next breakpoint). Each document is decoded anew only at its own breakpoints;
    the counts' changes are then summed over all documents in the order of the offsets (margins that shift between a document's breakpoints may
    change its choice a little, which isn't followed). 0 without candidates."""
    g = gold.select("doc_id", "s", "e", "ty").distinct().withColumn("_g", F.lit(1))
    x = cand.select("row", "doc_id", "s", "e").join(margins, "row").join(g, ["doc_id", "s", "e", "ty"], "left").withColumn("hit", F.coalesce("_g", F.lit(0)).cast("long"))
    x = x.select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.col("ty").cast("int").alias("ty"), "best", "second", "rejected", "hit")
    steps = x.groupBy("doc_id").applyInArrow(_steps, "theta double, d_tp long, d_pred long").groupBy("theta").agg(F.sum("d_tp").alias("d_tp"), F.sum("d_pred").alias("d_pred"))
    n = g.count()
    r = ranked(steps, "_k", ["theta"], sums={"tp": "d_tp", "pred": "d_pred"})
    f = r.select("theta", "_k", (2.0 * F.col("tp") / (F.col("pred") + n)).alias("f1")).where("f1 > 0").agg(F.max_by(F.struct("theta", "_k"), F.struct("f1", -F.col("_k"))).alias("b")).first()["b"]
    if f is None:
        return 0.0
    after = r.where(F.col("_k") == f["_k"] + 1).select("theta").first()
    return (f["theta"] + after[0]) / 2 if after else float(np.nextafter(f["theta"], INF))
