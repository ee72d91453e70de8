"""Span algebra: sets of (doc_id, s, e[, ty]), half open, in bytes. All of it joins within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ON = ["doc_id", "s", "e"]
MOST_REGIONS = 100_000


def numbered(x: DataFrame) -> DataFrame:
    """idx: place within the document by (s, e)."""
    return x.withColumn("idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("s", "e")) - 1).cast("int"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, s, e, idx): spans of either, each once."""
    return numbered(a.select(ON).unionByName(b.select(ON)).distinct())


def append(a: DataFrame, b: DataFrame, n_docs: int) -> DataFrame:
    """b's documents after a's n_docs."""
    return a.unionByName(b.withColumn("doc_id", F.col("doc_id") + n_docs))


def of_docs(x: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of the documents in (doc_id, new_id), under their new ids."""
    return x.join(docs, "doc_id").drop("doc_id").withColumnRenamed("new_id", "doc_id").select(x.columns)


def aligned(x: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans that begin where a token begins and end where one ends."""
    starts, ends = tokens.select("doc_id", "s").distinct(), tokens.select("doc_id", "e").distinct()
    return x.join(starts, ["doc_id", "s"], "left_semi").join(ends, ["doc_id", "e"], "left_semi").select(x.columns)


def outside(x: DataFrame, regions: DataFrame) -> DataFrame:
    """Spans that overlap none of the regions (lo, hi), which hold for every document: a short table, broadcast; a longer one is an error."""
    if regions.count() > MOST_REGIONS:
        raise ValueError(f"at most {MOST_REGIONS} regions")
    return x.join(F.broadcast(regions), (F.col("s") < F.col("hi")) & (F.col("e") > F.col("lo")), "left_anti")


def types_of(cand: DataFrame, gold: DataFrame, n_types: int) -> DataFrame:
    """cand with label: the type of the first gold span with the same bounds, n_types without any. gold: (doc_id, s, e, ty)."""
    first = gold.groupBy(ON).agg(F.min("ty").alias("_t")) if "idx" not in gold.columns else gold.groupBy(ON).agg(F.min_by("ty", "idx").alias("_t"))
    return cand.join(first, ON, "left").withColumn("label", F.coalesce("_t", F.lit(n_types)).cast("int")).drop("_t")


def matching(cand: DataFrame, gold: DataFrame) -> DataFrame:
    """cand with match: whether a gold span has its bounds."""
    g = gold.select(ON).distinct().withColumn("_g", F.lit(True))
    return cand.join(g, ON, "left").withColumn("match", F.coalesce("_g", F.lit(False))).drop("_g")


def _along(points: DataFrame, at: str, others: DataFrame, start: str) -> tuple[DataFrame, dict[str, WindowSpec]]:
    """Points and other spans of each document in one order, and the frames of what begins before a point, with it and after it: what joins of
    intervals need, without pairs. Points are the rows where _point is true."""
    both = points.withColumns({"_at": F.col(at), "_point": F.lit(True)}).unionByName(others.withColumns({"_at": F.col(start), "_point": F.lit(False)}), allowMissingColumns=True)
    w, back = Window.partitionBy("doc_id").orderBy("_at"), Window.partitionBy("doc_id").orderBy(F.desc("_at"))
    first = Window.unboundedPreceding
    return both, {"before": w.rangeBetween(first, -1), "with": w.rangeBetween(0, 0), "upto": w.rangeBetween(first, 0), "after": back.rangeBetween(first, -1)}


def contained(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """tokens with inside: whether they lie within a gold span."""
    both, frame = _along(tokens, "s", gold.select("doc_id", F.col("s").alias("_s"), F.col("e").alias("_e")), "_s")
    return both.withColumn("inside", F.coalesce(F.max("_e").over(frame["upto"]) >= F.col("e"), F.lit(False))).where("_point").select(*tokens.columns, "inside")


def coverage(cand: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: n_gold, covered (gold spans whose bounds a candidate has), share."""
    g = gold.join(cand.select(ON).distinct().withColumn("_c", F.lit(1)), ON, "left")
    return g.agg(F.count("*").alias("n_gold"), F.count("_c").alias("covered")).withColumn("share", F.when(F.col("n_gold") > 0, F.col("covered") / F.col("n_gold")).otherwise(0.0))


def ceiling(segments: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: n_gold, aligned (both bounds are segment bounds), share."""
    ok = aligned(gold, segments).count()
    return gold.agg(F.count("*").alias("n_gold")).withColumn("aligned", F.lit(ok).cast("long")).withColumn("share", F.when(F.col("n_gold") > 0, F.col("aligned") / F.col("n_gold")).otherwise(0.0))


def runs(tokens: DataFrame, inside: str = "inside") -> DataFrame:
    """(doc_id, s, e, n): the maximal runs of successive tokens (doc_id, idx, s, e) that are inside."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    x = tokens.withColumn("_run", F.sum(F.when(F.col(inside), 0).otherwise(1)).over(w)).where(F.col(inside))
    return x.groupBy("doc_id", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("_run")


def subspans(tokens: DataFrame, inside: str = "inside", most: int = 8) -> DataFrame:
    """(doc_id, s, e): all stretches of up to `most` successive tokens within a run."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    x = tokens.withColumn("_run", F.sum(F.when(F.col(inside), 0).otherwise(1)).over(w)).where(F.col(inside))
    ahead = F.collect_list("e").over(Window.partitionBy("doc_id", "_run").orderBy("idx").rowsBetween(0, most - 1))
    return x.select("doc_id", "s", ahead.alias("_ends")).select("doc_id", "s", F.explode("_ends").alias("e"))


def longest(x: DataFrame) -> DataFrame:
    """Greedy choice by start, then length: spans that begin before the last kept one's end go. Sequential within a document: a fold over its sorted spans."""
    item = F.struct(F.col("s").cast("long").alias("s"), (-F.col("e").cast("long")).alias("n"), F.col("id").cast("long").alias("id"))
    zero = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<struct<s:long,n:long,id:long>>").alias("kept"))
    step = lambda acc, v: F.when(v["s"] >= acc["last"], F.struct((-v["n"]).alias("last"), F.concat(acc["kept"], F.array(v)).alias("kept"))).otherwise(acc)
    g = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_a"))
    return g.select("doc_id", F.explode(F.aggregate("_a", zero, step)["kept"]).alias("k")).select("doc_id", F.col("k.s").alias("s"), (-F.col("k.n")).alias("e"), F.col("k.id").alias("id"))


def bio(tags: DataFrame, order: str = "idx") -> DataFrame:
    """(doc_id, s, e, ty) of runs of BIO tags. tags: (doc_id, order, s, e, bio, ty), ty null for types that aren't known: these have no span,
    and an inside tag of another type than the open span's begins a span of its own."""
    w = Window.partitionBy("doc_id").orderBy(order)
    known = F.col("bio").isin("B", "I") & F.col("ty").isNotNull()
    goes_on = known & (F.col("bio") == "I") & (F.lag(F.when(known, F.col("ty"))).over(w) == F.col("ty"))
    x = tags.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w)).where(known)
    return x.groupBy("doc_id", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("ty").alias("ty")).drop("_g")


def miss_report(gold: DataFrame, gaz: DataFrame, bio_: DataFrame) -> DataFrame:
    """(ty, outcome, by_gaz, by_bio, n): what became of the gold spans. Outcomes by precedence: covered (a span of the same bounds and type),
    wrong_type, over (a span around it), under (a span within it), cross, none. gold has idx, a number within the document. by_gaz and by_bio tell for `under` which source has such a span."""
    both = gaz.select("doc_id", F.col("s").alias("x"), F.col("e").alias("y"), F.col("ty").alias("t"), F.lit(0).alias("src")).unionByName(bio_.select("doc_id", F.col("s").alias("x"), F.col("e").alias("y"), F.col("ty").alias("t"), F.lit(1).alias("src")))
    g = gold.select("doc_id", "idx", "s", "e", "ty")
    no = F.lit(False)
    x, frame = _along(g, "s", both.select("doc_id", "x", "y", "src"), "x")
    over = F.coalesce(F.max("y").over(frame["before"]) >= F.col("e"), no) | F.coalesce(F.max("y").over(frame["with"]) > F.col("e"), no)

    def under_by(src: int) -> Column:
        y = F.when(F.col("src") == src, F.col("y"))
        return F.coalesce(F.min(y).over(frame["after"]) <= F.col("e"), no) | F.coalesce(F.min(y).over(frame["with"]) < F.col("e"), no)

    f = x.withColumns({"over": over, "ug": under_by(0), "ub": under_by(1)}).where("_point").select(*g.columns, "over", "ug", "ub")
    x, frame = _along(f, "e", both.select("doc_id", "x", "y"), "x")
    f = x.withColumn("some", F.coalesce(F.max("y").over(frame["before"]) > F.col("s"), no)).where("_point").select(*f.columns, "some")
    same = both.groupBy("doc_id", F.col("x").alias("s"), F.col("y").alias("e")).agg(F.collect_set("t").alias("types"))
    f = f.join(same, ON, "left").withColumns({"wrong": F.col("types").isNotNull(), "exact": F.coalesce(F.array_contains("types", F.col("ty")), no)})
    outcome = F.when(F.col("exact"), "covered").when(F.col("wrong"), "wrong_type").when(F.col("over"), "over").when(F.col("ug") | F.col("ub"), "under").when(F.col("some"), "cross").otherwise("none")
    under = outcome == "under"
    return f.select("ty", outcome.alias("outcome"), (under & F.col("ug")).alias("by_gaz"), (under & F.col("ub")).alias("by_bio")).groupBy("ty", "outcome", "by_gaz", "by_bio").agg(F.count("*").alias("n"))


def decode_report(gold: DataFrame, cand: DataFrame, n_types: int) -> DataFrame:
    """(ty, outcome, pred, n): gold spans by what the first candidate (doc_id, idx, s, e, pred) with their bounds was decided to be:
    not_in_pool, correct, false_reject (pred = n_types) or mistype; pred is given for mistypes, for a confusion table."""
    first = cand.groupBy(ON).agg(F.min_by("pred", "idx").alias("pred"))
    x = gold.join(first, ON, "left")
    outcome = F.when(F.col("pred").isNull(), "not_in_pool").when(F.col("pred") == n_types, "false_reject").when(F.col("pred") == F.col("ty"), "correct").otherwise("mistype")
    return x.select("ty", outcome.alias("outcome"), F.when(outcome == "mistype", F.col("pred")).alias("pred")).groupBy("ty", "outcome", "pred").agg(F.count("*").alias("n"))
