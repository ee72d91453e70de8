"""Mixing sources to target weights by min-cost flow.

Copies of one text may stand in several sources, so a text belongs to a set of sources, its membership pattern. Texts are aggregated by
pattern to token capacities. Capacity flows from patterns to those of their sources whose quotas need it; the first pass over a pattern's
tokens is free, and each further repetition costs more than the one before, so that repetition is spread evenly and used only where a
quota can't be met otherwise. What each pattern sends is then made up of its documents in a seeded order.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Work, hidden, shared_dir


def min_cost_flow(capacity: np.ndarray, edge_p: np.ndarray, edge_s: np.ndarray, quota: np.ndarray, repeats: int | None = None) -> np.ndarray:
    """Flow on each (pattern, source) edge that meets the most quota and, of those flows, costs the least; whole tokens, exact. Without `repeats`, any number of passes.

    The cost of a pattern's passes is convex and what patterns can send together is a polymatroid, so cheapest passes first is optimal: capacities
    grow pass by pass, and each time augmenting paths bring the flow to its maximum. Paths run over sources (few); every step of
    one moves as much as it can over all patterns (many) at once.
    """
    P, S = capacity.size, quota.size
    flow, used, need = np.zeros(edge_p.size, np.int64), np.zeros(P, np.int64), quota.astype(np.int64).copy()
    edges_of = [np.flatnonzero(edge_s == s) for s in range(S)]
    slot = np.full(P, -1)

    def shiftable(s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges to s that carry flow, and the edges to t of the same patterns."""
        mine = edges_of[s][flow[edges_of[s]] > 0]
        slot[edge_p[edges_of[t]]] = edges_of[t]
        other = slot[edge_p[mine]]
        slot[edge_p[edges_of[t]]] = -1
        return mine[other >= 0], other[other >= 0]

    def take(amounts: np.ndarray, total: int) -> np.ndarray:
        """The first `total` of the amounts, in order."""
        before = np.cumsum(amounts) - amounts
        return np.clip(total - before, 0, amounts)

    turn = 0
    while turn != repeats and any(need[s] > 0 and capacity[edge_p[edges_of[s]]].any() for s in range(S)):
        turn += 1
        room = capacity * turn - used
        before = flow.copy(), used.copy(), need.copy()
        while True:
            parent: dict[int, int] = {s: -1 for s in range(S) if room[edge_p[edges_of[s]]].any()}
            queue, goal = list(parent), next((s for s in parent if need[s] > 0), None)
            while queue and goal is None:
                s = queue.pop(0)
                for t in np.unique(edge_s[np.isin(edge_p, edge_p[edges_of[s]][flow[edges_of[s]] > 0])]):
                    t = int(t)
                    if t not in parent:
                        parent[t] = s
                        queue.append(t)
                        if need[t] > 0:
                            goal = t
                            break
            if goal is None:
                break
            path = [goal]
            while parent[path[0]] >= 0:
                path.insert(0, parent[path[0]])
            steps = [shiftable(a, b) for a, b in zip(path, path[1:])]
            first = edges_of[path[0]]
            push = int(min([need[goal], room[edge_p[first]].sum(), *(flow[m].sum() for m, _ in steps)]))
            x = take(room[edge_p[first]], push)
            flow[first] += x
            np.add.at(used, edge_p[first], x)
            room = capacity * turn - used
            for m, o in steps:
                x = take(flow[m], push)
                flow[m] -= x
                flow[o] += x
            need[goal] -= push
        df, du, dn = flow - before[0], used - before[1], before[2] - need
        if du.any() and not ((dn > 0) & (need == 0)).any():  # as long as no quota is full and no edge empty, the next passes go like this one
            most = min([int((x[d > 0] // d[d > 0]).min()) for x, d in ((need, dn), (flow, -df)) if (d > 0).any()]) - 1
            m = max(0, most if repeats is None else min(most, repeats - turn))
            flow, used, need, turn = flow + m * df, used + m * du, need - m * dn, turn + m
    return flow


def quotas(tokens: np.ndarray, weights: dict[str, float] | None, names: list[str], total: float, temperature: float) -> list[int]:
    """Tokens wanted of each source: the weights' shares of the total, or, without weights, those of the sources' tokens to the power `temperature`."""
    w = np.array([max(0.0, (weights or {}).get(s, 0.0)) for s in names]) if weights is not None else np.where(tokens > 0, tokens, 0).astype(float) ** temperature
    w = w / w.sum() if w.sum() > 0 else w
    return [int(round(x * total)) for x in w]


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = 0.7, repeats: int | None = None, seed: int = 17, slots: int = 4096) -> DataFrame:
    """The rows of `docs` chosen for the mixture, one for each text, with two more columns: `mix_source`, the source it counts for, and
    `mix_repeats`, how often it is to be read.

    weights: wanted share of each source (others get none); by default shares go with tokens ** temperature. total: tokens wanted; by default as many as
    all different texts have. repeats: passes over a pattern's tokens at most, if given; by default as many as the quotas need. A token is a run of
    non-blanks. Quotas of sources without tokens, or beyond `repeats`, are filled as far as possible.

    A text that stands in several rows counts once, under the row with the least doc_id (null last, then by source, then by all columns as JSON), for the
    pattern of all its sources. Documents with the hash of (doc_id, text, seed) below a threshold are chosen, to the nearest document: the
    threshold is found from `slots` sums, then exactly among the documents of one slot, so no pattern is ordered in one place.
    Null sources are the source ''. Null texts and those without tokens are never chosen. Columns of `docs` named mix_source or mix_repeats are
    replaced; others may have any names and types. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    work = Work(spark)
    docs = docs.drop("mix_source", "mix_repeats")
    text = F.col("text").cast("string")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    h1, h2 = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    tokens = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    slim = docs.where(text.isNotNull()).select(h1.alias("_h1"), h2.alias("_h2"), source.alias("_s"), F.col("doc_id").cast("long").alias("_id"), tokens.alias("_n")).where("_n > 0")
    one = slim.groupBy("_h1", "_h2").agg(F.array_sort(F.collect_set("_s")).alias("_p"), F.min(F.struct(F.col("_id").isNull().alias("_z"), F.col("_id"), F.col("_s"))).alias("_first"), F.first("_n").alias("_n"), (F.count("*") > 1).alias("_many"))
    u = F.xxhash64("_h1", "_h2", F.lit(seed))
    one = one.select("_h1", "_h2", F.to_json("_p").alias("_p"), F.xxhash64("_p").alias("_pid"), F.col("_first._id").alias("_id"), F.col("_first._s").alias("_s"), "_n", "_many", u.alias("_u"), F.pmod(F.shiftright(u, 40), F.lit(slots)).alias("_slot"))
    one = work.table(one)
    sums = one.groupBy("_pid").agg(F.min("_p").alias("_p"), F.sum("_n").alias("n")).orderBy("_p").toPandas()
    patterns = [json.loads(p) for p in sums["_p"]]
    names = sorted({s for p in patterns for s in p})
    number = {s: i for i, s in enumerate(names)}
    capacity = sums["n"].to_numpy(np.int64)
    edge_p = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns]).astype(np.int64)
    edge_s = np.array([number[s] for p in patterns for s in p], np.int64)
    share = capacity[edge_p] / np.bincount(edge_p, minlength=1)[edge_p] if edge_p.size else np.zeros(0)
    held = np.bincount(edge_s, weights=share, minlength=len(names))
    wanted = np.array(quotas(held, weights, names, float(total if total is not None else capacity.sum()), temperature), np.int64)
    flow = min_cost_flow(capacity, edge_p, edge_s, wanted, repeats)

    # a pattern's documents in the order of their hash are run through over and over; its sources get stretches of that run, cut by passes
    rows, start = [], np.zeros(capacity.size, np.int64)
    for e in np.flatnonzero(flow):
        p, c = edge_p[e], int(capacity[edge_p[e]])
        at, end = int(start[p]), int(start[p] + flow[e])
        start[p] = end
        while at < end:
            turn = at // c
            stop = min(end, (turn + 1) * c)
            if at == turn * c and end - at >= 2 * c:  # whole passes in one row
                stop = at + (end - at) // c * c
                rows.append((int(sums["_pid"][p]), names[edge_s[e]], turn, (stop - at) // c, 0, c))
            else:
                rows.append((int(sums["_pid"][p]), names[edge_s[e]], turn, 1, at - turn * c, stop - turn * c))
            at = stop
    plan = spark.createDataFrame(pd.DataFrame(rows, columns=["_pid", "mix_source", "turn", "times", "lo", "hi"]).astype({"_pid": "int64", "turn": "int64", "times": "int64", "lo": "int64", "hi": "int64"}), "_pid long, mix_source string, turn long, times long, lo long, hi long")
    by_slot = one.groupBy("_pid", "_slot").agg(F.sum("_n").alias("_m"))
    by_slot = by_slot.select("_pid", "_slot", (F.sum("_m").over(Window.partitionBy("_pid").orderBy("_slot")) - F.col("_m")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_pid", "_slot").orderBy("_u", "_h1", "_h2"))
    placed = one.join(by_slot, ["_pid", "_slot"]).withColumn("_at", F.col("_before") + inside - F.floor((F.col("_n") + 1) / 2))
    chosen = placed.join(plan, "_pid").where("_at >= lo AND _at < hi").groupBy("_h1", "_h2", "_id", "_s", "_many").agg(F.min_by("mix_source", "turn").alias("mix_source"), F.sum("times").cast("int").alias("mix_repeats"))
    chosen = chosen.checkpoint()
    work.drop()
    k1, k2, c1, c2, id_, s_, many, row = hidden(docs, "k1", "k2", "c1", "c2", "id", "s", "many", "row")
    keyed = docs.where(text.isNotNull()).withColumns({k1: h1, k2: h2})
    c = chosen.toDF(c1, c2, id_, s_, many, "mix_source", "mix_repeats")
    on = (keyed[k1] == c[c1]) & (keyed[k2] == c[c2]) & keyed["doc_id"].cast("long").eqNullSafe(c[id_]) & (F.coalesce(keyed["source"].cast("string"), F.lit("")) == c[s_])
    found = keyed.join(c, on)
    every = F.struct(*[F.col(f"`{x}`") for x in docs.columns], "mix_source", "mix_repeats")
    again = found.where(many).groupBy(k1, k2).agg(F.min_by(every, F.to_json(every)).alias(row))
    columns = [*docs.columns, "mix_source", "mix_repeats"]
    return found.where(~F.col(many)).select([F.col(f"`{x}`") for x in columns]).unionByName(again.select(*[F.col(row)[x].alias(x) for x in columns]))
