"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Relative entropy in nats that shares may have to their targets where no budget is given. By
#: Pinsker's inequality no share is then more than 0.0000003 off its target.
MOST_DIVERGENCE = 1e-13


def tempered(shares: np.ndarray, exponent: float, toward: np.ndarray | None = None) -> np.ndarray:
    """Source shares raised to a power and normalised. With ``toward``, the family runs
    from the natural shares (exponent 0) to ``toward`` (exponent 1):
    natural * (toward / natural) ** exponent. Sources without tokens keep weight 0."""
    w, live = np.zeros(len(shares)), shares > 0
    if toward is None:
        w[live] = shares[live] ** exponent
    else:
        live &= toward > 0
        w[live] = shares[live] * (toward[live] / shares[live]) ** exponent
    return w / w.sum() if w.sum() > 0 else w


def bisect_exponent(ok: Callable[[float], bool], lo: float, hi: float, rounds: int = 60) -> float:
    """The greatest exponent in lo..hi that is ok, where being ok ends once along the way."""
    if ok(hi):
        return hi
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def entropy(w: np.ndarray) -> float:
    p = w[w > 0]
    return float(-(p * np.log(p)).sum())


def exponent_for_entropy(shares: np.ndarray, target: float) -> float:
    """Exponent at which the tempered shares have the target entropy (0: uniform)."""
    return bisect_exponent(lambda t: entropy(tempered(shares, t)) >= target, 0.0, 64.0)


def divergence(goal: np.ndarray, w: np.ndarray) -> float:
    """Relative entropy of ``goal`` seen from ``w``, in nats."""
    p = goal > 0
    return float((goal[p] * np.log(goal[p] / w[p])).sum()) if (w[p] > 0).all() else float("inf")


def exponent_for_divergence(natural: np.ndarray, goal: np.ndarray, most: float) -> float:
    """The least exponent in 0..1 at which the shares on the way from ``natural`` to ``goal`` are
    within ``most`` nats of the goal; on that way the relative entropy only falls."""
    return 1.0 - bisect_exponent(lambda u: divergence(goal, tempered(natural, 1.0 - u, goal)) <= most, 0.0, 1.0)


@dataclass
class Mixture:
    sources: list[str]
    tokens: np.ndarray
    weights: np.ndarray
    budget: float
    exponent: float


def solve(sources: list[str], tokens: np.ndarray, target: np.ndarray, repeats: np.ndarray, budget: float | None = None) -> Mixture:
    """Weights and token budget. Targets of sources that have no tokens are spread over the
    others in proportion. Without a budget the exponent toward the targets is bisected to the
    least at which the shares have no more than MOST_DIVERGENCE of relative entropy to them, and
    the budget is the greatest that keeps every repetition limit at those shares. With a
    budget, the exponent is bisected to the greatest that keeps the limits, and the budget is
    cut only if even the natural shares break them."""
    live = (tokens > 0) & (target > 0) & (repeats > 0)
    goal = np.where(live, target, 0.0)
    goal = goal / goal.sum() if goal.sum() > 0 else goal
    natural = np.where(live, tokens, 0).astype(float)
    natural = natural / natural.sum() if natural.sum() > 0 else natural
    room = np.where(live, tokens * repeats, 0).astype(float)
    if not live.any():
        return Mixture(sources, tokens, goal, 0.0, 1.0)
    most = lambda w: float((room[w > 0] / w[w > 0]).min())
    if budget is None:
        t = exponent_for_divergence(natural, goal, MOST_DIVERGENCE)
        w = tempered(natural, t, goal)
        return Mixture(sources, tokens, w, most(w), t)
    t = bisect_exponent(lambda t: budget <= most(tempered(natural, t, goal)) * (1 + 1e-12), 0.0, 1.0)
    w = tempered(natural, t, goal)
    return Mixture(sources, tokens, w, min(budget, most(w)), t)


def _fill(x: pd.DataFrame) -> pd.DataFrame:
    """The items of the bucket with the cut-off, in their order, that the rest has room for."""
    x = x.sort_values(["order_key", "item"])
    room, take = int(x["rest"].iloc[0] - x["before"].iloc[0]), []
    for n in x["n"]:
        take.append(n <= room)
        room -= n if take[-1] else 0
    return x[np.array(take, bool)]


def mix(docs: DataFrame, targets: DataFrame, item: str = "doc_id", source: str = "source", size: str = "n_tokens", budget: float | None = None, seed: int = 17, bucket_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(selection, report). Selection: item, source, pass_no, n_tokens, order_key — one row
    per time an item is taken; rows of a pass in order_key order are its permutation.

    Each source gives whole passes (blocks) over all its items and one last pass cut off
    at its budget, so an item is taken at most max_repeats times. The cut-off is found
    from token sums of hashed buckets, and only the one bucket that holds it (about
    ``bucket_rows`` items) is put in order and filled: a source with any share of the
    rows is never put in order in one task. Items of
    unlisted or null sources, and items without tokens, are not taken; repeated target
    rows count once; a null share or limit is 0. No source with tokens gives no rows.
    """
    t = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("reps"))
    live = docs.where(F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(size).cast("long").alias("n"))
    sums = live.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = t.join(sums, t[source] == sums["source"], "left").select(t[source].alias("s"), F.coalesce("share", F.lit(0.0)), F.coalesce("reps", F.lit(0)), F.coalesce("tokens", F.lit(0)), F.coalesce("docs", F.lit(0))).orderBy("s").collect()  # one row per listed source
    names, share, reps, tokens, n_docs = ([r[i] for r in rows] for i in range(5))
    m = solve(names, np.array(tokens, float), np.array(share, float), np.array(reps, float), budget)
    plan = []
    for i, s in enumerate(names):
        b = m.budget * float(m.weights[i]) if len(m.weights) else 0.0
        if b > 0:
            whole = int(b // tokens[i])
            plan.append((s, whole, int(round(b - whole * tokens[i])), max(1, -(-int(n_docs[i]) // bucket_rows))))
    spark = docs.sparkSession
    p = spark.createDataFrame(plan, "source string, whole int, rest long, buckets int")
    d = live.join(F.broadcast(p), "source")
    passes = F.sequence(F.lit(0), F.col("whole"))
    d = d.select("item", "source", "n", "whole", "rest", "buckets", F.explode(passes).alias("pass_no")).where("pass_no < whole or rest > 0")
    d = d.withColumn("order_key", F.xxhash64("item", F.lit(seed), "pass_no"))
    last = d.where("pass_no = whole").withColumn("bucket", F.floor((F.shiftright("order_key", 33) + F.lit(1 << 30)) * F.col("buckets") / F.lit(1 << 31)).cast("int"))
    per = last.groupBy("source", "bucket").agg(F.sum("n").alias("c"))
    before = per.select("source", "bucket", (F.sum("c").over(W.partitionBy("source").orderBy("bucket")) - F.col("c")).alias("before"), "c")
    last = last.join(before, ["source", "bucket"]).where("before < rest")
    inside = last.where("before + c <= rest")
    edge = last.where("before + c > rest").groupBy("source", "bucket").applyInPandas(_fill, last.schema)
    cols = ["item", "source", "pass_no", "n", "order_key"]
    chosen = d.where("pass_no < whole").select(*cols).unionByName(inside.select(*cols)).unionByName(edge.select(*cols))
    selection = chosen.select(F.col("item").alias(item), F.col("source").alias(source), "pass_no", F.col("n").alias(size), "order_key")
    goal = spark.createDataFrame(
        [(s, float(share[i]), float(m.weights[i]) if len(m.weights) else 0.0, int(reps[i]), int(tokens[i])) for i, s in enumerate(names)],
        "source string, target_share double, planned_share double, max_repeats int, tokens_there long",
    )
    got = selection.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("tokens_taken"), F.count(F.lit(1)).alias("rows_taken"), (F.max("pass_no") + 1).alias("most_repeats"))
    report = goal.join(got, "source", "left").fillna(0, ["tokens_taken", "rows_taken", "most_repeats"])
    all_ = report.agg(F.sum("tokens_taken").alias("__all"))
    report = report.crossJoin(F.broadcast(all_)).withColumn("actual_share", F.when(F.col("__all") > 0, F.col("tokens_taken") / F.col("__all")).otherwise(0.0)).drop("__all")
    return selection, report
