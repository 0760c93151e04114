"""Confidence tuning: distribution, boosting, calibration, voting, filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Entity types with a boost of their own.
BOOSTED_TYPES = ("Action", "Parameter")


def distribution(df: DataFrame, by: list[str] | None = None, col: str = "confidence") -> DataFrame:
    """Count, mean, population deviation, range and percentiles (linear); nulls left out."""
    c = F.col(col)
    aggs = [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.percentile(c, F.array(*(F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q")]
    out = df.groupBy(*(by or [])).agg(*aggs)
    return out.select(*(by or []), "n", *(F.round(x, 6).alias(x) for x in ("mean", "std", "lo", "hi")), *(F.round(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))))


def anomalies(df: DataFrame, col: str = "confidence") -> DataFrame:
    """Rows outside 1.5 interquartile ranges."""
    q = df.agg(F.percentile(col, 0.25).alias("q1"), F.percentile(col, 0.75).alias("q3"))  # one row
    x = df.crossJoin(F.broadcast(q))
    r = 1.5 * (F.col("q3") - F.col("q1"))
    return x.where((F.col(col) < F.col("q1") - r) | (F.col(col) > F.col("q3") + r)).drop("q1", "q3")


def recommended_threshold(df: DataFrame, keep: float, col: str = "confidence") -> DataFrame:
    """The value at 0-based place int(n * (1 - keep)) of the sorted confidences.

    Ranks are counted per distinct value, so no sort of all rows in one task."""
    per = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("c"))
    n = per.agg(F.sum("c").alias("n"))
    upto = per.withColumn("upto", F.sum("c").over(W.orderBy(col)))
    return upto.crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("n") * F.round(F.lit(1.0) - keep, 9))).agg(F.min(col).alias("threshold"))


def boost(df: DataFrame, n_sources: str = "n_sources", kind: str = "entity_type", col: str = "confidence") -> DataFrame:
    """+.15 (n-1)/2 from two sources on, +.05 for the boosted types, capped at .99."""
    more = F.when(F.col(n_sources) >= 2, 0.15 * (F.col(n_sources) - 1) / 2).otherwise(0.0)
    typed = F.when(F.col(kind).isin(*BOOSTED_TYPES), 0.05).otherwise(0.0)
    return df.withColumn(col, F.least(F.lit(0.99), F.col(col) + more + typed))


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) least-squares fit of y at sorted x by pooling neighbours."""
    level, weight, size = [], [], []
    for v, k in zip(y, w):
        level.append(float(v))
        weight.append(float(k))
        size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            k2 = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / k2]
            weight[-2:] = [k2]
            size[-2:] = [size[-2] + size[-1]]
    return np.repeat(level, size)


def fit_calibrator(df: DataFrame, kind: str = "kind", col: str = "confidence", truth: str = "correct") -> DataFrame:
    """(kind, x, y, n): isotonic steps of each kind with two or more pairs.

    Pairs are first averaged per distinct confidence rounded to six places, so that a
    kind of any size comes to its task as at most a million rows."""
    per = df.where(F.col(col).isNotNull() & F.col(truth).isNotNull()).groupBy(kind, F.round(col, 6).alias("x")).agg(F.avg(truth).alias("m"), F.count(F.lit(1)).alias("w"))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        if p["w"].sum() < 2:
            return pd.DataFrame({kind: p[kind], "x": p["x"], "y": p["m"], "n": p["w"]}).iloc[:0]
        p = p.sort_values("x")
        return pd.DataFrame({kind: p[kind], "x": p["x"], "y": pool_adjacent(p["x"].to_numpy(), p["m"].to_numpy(), p["w"].to_numpy()).astype(float), "n": int(p["w"].sum())})

    t = df.schema[kind].dataType.simpleString()
    return per.groupBy(kind).applyInPandas(fit, f"`{kind}` {t}, x double, y double, n long")


def calibrate(df: DataFrame, steps: DataFrame, kind: str = "kind", col: str = "confidence") -> DataFrame:
    """Adds calibrated (linear between the steps, clipped beyond) and uncertainty (1/n);
    kinds that weren't fitted keep their value with uncertainty .9."""
    table = steps.groupBy(kind).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("s"), F.max("n").alias("k"))
    j = df.join(table, kind, "left")
    before = F.filter("s", lambda p: p["x"] <= F.col(col))
    after = F.filter("s", lambda p: p["x"] >= F.col(col))
    lo, hi = F.coalesce(F.try_element_at(before, F.lit(-1)), F.col("s")[0]), F.coalesce(F.try_element_at(after, F.lit(1)), F.try_element_at("s", F.lit(-1)))
    y = F.when(hi["x"] > lo["x"], lo["y"] + (hi["y"] - lo["y"]) * (F.col(col) - lo["x"]) / (hi["x"] - lo["x"])).otherwise(lo["y"])
    return j.withColumn("calibrated", F.when(F.col("s").isNull(), F.col(col)).otherwise(y)).withColumn("uncertainty", F.when(F.col("s").isNull(), 0.9).otherwise(1 / F.col("k"))).drop("s", "k")


def disputes(df: DataFrame, threshold: float | None = None, col: str = "confidence") -> DataFrame:
    """Rows under the threshold; none or 0 means .75."""
    return df.where(F.col(col) < (threshold or 0.75))


def vote(df: DataFrame, accepted: str, col: str = "confidence") -> DataFrame:
    """Accepted: +.05 up to .99; rejected: -.1 down to .1; no vote: unchanged."""
    a = F.col(accepted)
    return df.withColumn(col, F.when(a, F.least(F.col(col) + 0.05, F.lit(0.99))).when(~a, F.greatest(F.col(col) - 0.1, F.lit(0.1))).otherwise(F.col(col)))


def quality_filter(df: DataFrame, min_confidence: float = 0.7, has_evidence: str = "n_sources", description: str = "description", col: str = "confidence") -> DataFrame:
    return df.where((F.col(col) >= min_confidence) & (F.coalesce(F.col(has_evidence), F.lit(0)) > 0) & (F.length(F.coalesce(description, F.lit(""))) > 0))


def quality_report(before: DataFrame, after: DataFrame, kind: str = "entity_type", col: str = "confidence") -> DataFrame:
    """One row: counts, removal rate, range and mean after, and the issues found."""
    b = before.agg(F.count(F.lit(1)).alias("n_before"))
    a = after.agg(F.count(F.lit(1)).alias("n_after"), F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("mean"))
    single = after.groupBy(kind).count().where("count = 1").agg(F.count(F.lit(1)).alias("n_single"))
    x = b.crossJoin(a).crossJoin(single).withColumn("removed", F.when(F.col("n_before") > 0, 1 - F.col("n_after") / F.col("n_before")).otherwise(0.0))
    issue = lambda c, t: F.when(c, F.lit(t))
    issues = F.array_compact(F.array(issue(F.col("removed") > 0.5, "high removal"), issue(F.col("n_single") > 0, "singleton types"), issue(F.col("mean") < 0.75, "low mean"), issue(F.col("lo") < 0.7, "low minimum")))
    return x.select("n_before", "n_after", F.round("removed", 6).alias("removed"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("mean", 6).alias("mean"), "n_single", F.concat_ws(", ", issues).alias("issues"))


def votes_from(provider, df: DataFrame, schema: str) -> DataFrame:
    """Votes of a model behind ``provider.vote_batch(pandas frame) -> pandas frame``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield provider.vote_batch(x)

    return df.mapInPandas(run, schema)
