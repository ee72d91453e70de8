"""Weights of sparse features: IDF, norms, standardisation, relevance (bi-normal separation, AUC), column and group scales.

A matrix is (row, col, val); weights are (col, w). Everything is a grouped aggregate joined back on the column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.containers import ranked, short

FLOOR = 1e-6


def idf(x: DataFrame, n: int) -> DataFrame:
    """(col, w): ln(n / df)."""
    return x.groupBy("col").agg(F.count("*").alias("df")).select("col", F.log(F.lit(float(n)) / F.col("df")).alias("w"))


def scaled(x: DataFrame, w: DataFrame) -> DataFrame:
    """x with every value times its column's weight; columns without a weight go."""
    return x.join(w, "col").select("row", "col", (F.col("val").cast("double") * F.col("w")).alias("val"))


def normalized(x: DataFrame) -> DataFrame:
    """Rows of unit length; rows of zeros stay as they are."""
    n = F.sqrt(F.sum(F.col("val").cast("double") * F.col("val")).over(Window.partitionBy("row")))
    return x.withColumn("_n", n).select("row", "col", F.when(F.col("_n") > 0, F.col("val") / F.col("_n")).otherwise(F.col("val")).alias("val"))


def sumsq(x: DataFrame) -> DataFrame:
    """(col, sumsq)."""
    return x.groupBy("col").agg(F.sum(F.col("val").cast("double") * F.col("val")).alias("sumsq"))


def rms(x: DataFrame, n: int) -> DataFrame:
    """(col, w): sqrt(n / sum of squares), 0 for columns of zeros; applied to training and evaluation blocks alike."""
    return sumsq(x).select("col", F.when(F.col("sumsq") > 0, F.sqrt(F.lit(float(n)) / F.col("sumsq"))).otherwise(0.0).alias("w"))


def standardized(x: DataFrame, n: int) -> DataFrame:
    """Columns scaled to unit standard deviation about their mean, zeros counted; sparse, so they aren't centred."""
    s = x.groupBy("col").agg(F.sum(F.col("val").cast("double")).alias("a"), F.sum(F.col("val").cast("double") * F.col("val")).alias("b"))
    var = F.col("b") / n - (F.col("a") / n) * (F.col("a") / n)
    return scaled(x, s.select("col", F.when(var > 1e-12, 1 / F.sqrt(var)).otherwise(1.0).alias("w")))


def centred(x: DataFrame, code: str) -> DataFrame:
    """A dense column less its mean vector."""
    mean = x.select(F.posexplode(code).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("_mean"))
    return x.crossJoin(F.broadcast(mean)).withColumn(code, F.zip_with(code, "_mean", lambda a, b: a.cast("double") - b)).drop("_mean")


def row_norms(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, inv_norm) over blocks (row, col, val, scale, colscale): 1 / length of the scaled row, 0 if it is empty."""
    v = F.col("val").cast("double") * F.col("scale") * F.coalesce("colscale", F.lit(1.0))
    q = blocks.groupBy("row").agg(F.sum(v * v).alias("q"))
    return rows.select("row").join(q, "row", "left").select("row", F.when(F.col("q") > 0, 1 / F.sqrt("q")).otherwise(0.0).alias("inv_norm"))


def label_mean(labels: DataFrame, n: int) -> DataFrame:
    """(label, mean): share of rows with each label."""
    return labels.groupBy("label").agg((F.count("*") / F.lit(float(n))).alias("mean"))


def contingency(x: DataFrame, labels: DataFrame) -> DataFrame:
    """(col, label, tp): rows with the feature and the label; the labels side is small or joined by row."""
    return x.select("row", "col").join(labels, "row").groupBy("col", "label").agg(F.count("*").alias("tp"))


def probit(p: Column) -> Column:
    """Inverse of the normal distribution function by Acklam's rational approximation (relative error 1.2e-9), as an expression."""

    def poly(x: Column, c: list[float]) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * x + k
        return out

    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
    tail = lambda q: poly(F.sqrt(-2 * F.log(q)), c) / poly(F.sqrt(-2 * F.log(q)), d)
    q = p - 0.5
    mid = poly(q * q, a) * q / poly(q * q, b)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(mid)


def bns(x: DataFrame, labels: DataFrame, n: int, clip: float = 5e-4) -> DataFrame:
    """(col, w): bi-normal separation, |probit(true positive rate) - probit(false positive rate)|, the greatest over the labels.

    Rates are clipped to [clip, 1 - clip]. labels: (row, label)."""
    size = labels.groupBy("label").agg(F.count("*").alias("pos"))
    df = x.groupBy("col").agg(F.count("*").alias("df"))
    t = contingency(x, labels).join(short(size), "label").join(df, "col")
    rate = lambda a, b: F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.when(b > 0, a / b).otherwise(0.0)))
    w = F.abs(probit(rate(F.col("tp"), F.col("pos"))) - probit(rate(F.col("df") - F.col("tp"), n - F.col("pos"))))
    return t.groupBy("col").agg(F.max(w).alias("w"))


def auc(x: DataFrame, positive: DataFrame, n: int) -> DataFrame:
    """(col, w): 2 |AUC - 1/2| of each column's values for telling the rows in `positive` (row) from the others.

    By rank sums; rows without an entry have 0 and tie. Ranks are taken among a column's entries only, zeros are accounted for in total."""
    pos = positive.select("row").distinct().withColumn("y", F.lit(1))
    n_pos = positive.select("row").distinct().count()
    v = x.join(pos, "row", "left").select("col", F.col("val").cast("double").alias("val"), F.coalesce("y", F.lit(0)).alias("y"))
    g = v.groupBy("col", "val").agg(F.sum("y").alias("p"), F.count("*").alias("m"))
    held = g.groupBy("col").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    zeros = held.where(F.col("m") < n).select("col", F.lit(0.0).alias("val"), (n_pos - F.col("p")).alias("p"), (n - F.col("m")).alias("m"))
    g = g.unionByName(zeros).groupBy("col", "val").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    before = F.sum(F.col("m") - F.col("p")).over(Window.partitionBy("col").orderBy("val")) - (F.col("m") - F.col("p"))
    u = g.withColumn("u", F.col("p") * (before + (F.col("m") - F.col("p")) / 2)).groupBy("col").agg(F.sum("u").alias("u"))
    pairs = float(n_pos) * float(n - n_pos)
    return u.select("col", (F.abs(F.col("u") / pairs - 0.5) * 2 if pairs else F.lit(0.0)).alias("w"))


def auc_target(x: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """(col, w): 2 |AUC - 1/2| of a target (row, target) for telling the rows that have an entry in a column from the others, by mean ranks of the target."""
    place = ranked(targets.select("row", "target"), "_k", ["target", "row"])
    mean = place.groupBy("target").agg((F.avg("_k") + 1).alias("rank"))
    r = place.join(mean, "target").select("row", "rank")
    t = x.select("row", "col").distinct().join(r, "row").groupBy("col").agg(F.sum("rank").alias("s"), F.count("*").cast("double").alias("m"))
    pairs = F.col("m") * (n - F.col("m"))
    return t.select("col", F.when(pairs > 0, F.abs((F.col("s") - F.col("m") * (F.col("m") + 1) / 2) / pairs - 0.5) * 2).otherwise(0.0).alias("w"))


def target_mean(targets: DataFrame) -> DataFrame:
    """(mean,) of a target (row, target)."""
    return targets.agg(F.avg(F.col("target").cast("double")).alias("mean"))


def colscale(w: DataFrame, exponent: float, floor: float = FLOOR) -> DataFrame:
    """(col, cs): (max(w, floor) / geometric mean) ** exponent."""
    m = F.log(F.greatest(F.col("w"), F.lit(floor)))
    mean = w.agg(F.avg(m).alias("_g"))
    return w.crossJoin(F.broadcast(mean)).select("col", F.exp(exponent * (m - F.col("_g"))).alias("cs"))


def gauge(cs: DataFrame, squares: DataFrame, n: int, scale: float = 1.0) -> DataFrame:
    """(col, w): colscale times scale * sqrt(n / weighted sum of squares), so that a block's mean squared row length is scale ** 2."""
    total = cs.join(squares, "col").agg(F.sum(F.col("cs") * F.col("cs") * F.col("sumsq")).alias("_t"))
    return cs.crossJoin(F.broadcast(total)).select("col", (F.col("cs") * F.when(F.col("_t") > 0, scale * F.sqrt(F.lit(float(n)) / F.col("_t"))).otherwise(0.0)).alias("w"))


def group_gauge(cs: DataFrame, squares: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """gauge() for each group of columns by itself. groups: (group, lo, hi, scale), columns lo <= col < hi; a short table, broadcast."""
    c = cs.join(squares, "col", "left").join(F.broadcast(groups), (F.col("col") >= F.col("lo")) & (F.col("col") < F.col("hi")))
    t = F.sum(F.col("cs") * F.col("cs") * F.coalesce("sumsq", F.lit(0.0))).over(Window.partitionBy("group"))
    return c.withColumn("_t", t).select("col", "group", (F.col("cs") * F.when(F.col("_t") > 0, F.col("scale") * F.sqrt(F.lit(float(n)) / F.col("_t"))).otherwise(0.0)).alias("w"))


def block_weights(weights: DataFrame, squares: DataFrame, n: int, exponent: float | None, scale: float) -> DataFrame:
    """A block's final column weights from its relevance, a searched exponent (None: no relevance) and scale."""
    cs = weights.select("col", F.lit(1.0).alias("cs")) if exponent is None else colscale(weights, exponent)
    return gauge(cs, squares, n, scale)
