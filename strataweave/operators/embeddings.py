"""Embedding analytics: clustering, projection, coherence, walks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataweave.operators.retrieval import cosine, dot
from strataweave.plans.lineage import write_stage

#: Vectors that a pairwise comparison of two spaces is made for.
MOST_COMPARED = 20_000
#: Columns of the subspace iteration beside those asked for.
EXTRA = 6


def collect(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """One row per key with a vector of ``dim`` values."""
    return df.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(key, vector).dropDuplicates([key])


def _features(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>")))


def kmeans(df: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """(key, cluster); k is max(2, int(sqrt(n / 2))) unless given."""
    from pyspark.ml.clustering import KMeans

    x = _features(df.where(F.col(vector).isNotNull()), vector)
    k = k or max(2, int(math.sqrt(x.count() / 2)))
    m = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster").fit(x)
    return m.transform(x).select(key, "cluster")


def cluster_quality(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """One row: clusters, inertia (squared distances to the cluster's mean) and the mean silhouette
    by Euclidean distance, exact: blocks of rows meet, and every row's distances are summed
    by cluster. A row alone in its cluster counts 0; one cluster has silhouette 0."""
    from strataweave.operators.merging import block_pairs

    x = df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(cluster).cast("long").alias("c"))
    groups, _ = block_pairs(x, "k")
    kind = x.schema["k"].dataType.simpleString()

    def sums(p: pd.DataFrame) -> pd.DataFrame:
        one = p[p["left"]]
        two = p[~p["left"]] if len(p) > len(one) else one
        out = []
        for a, b in ((one, two),) if two is one else ((one, two), (two, one)):
            if not len(a) or not len(b):
                continue
            va, vb, cb = np.stack(a["v"]), np.stack(b["v"]), b["c"].to_numpy()
            names, code = np.unique(cb, return_inverse=True)
            hot = np.zeros((len(b), len(names)))
            hot[np.arange(len(b)), code] = 1
            for s in range(0, len(a), 512):
                t = va[s : s + 512]
                d = np.sqrt(np.maximum((t * t).sum(1)[:, None] + (vb * vb).sum(1)[None] - 2 * t @ vb.T, 0))
                m = d @ hot
                i, j = np.nonzero(np.ones_like(m))
                out.append(pd.DataFrame({"k": a["k"].to_numpy()[s + i], "c": a["c"].to_numpy()[s + i], "o": names[j], "d": m[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"k": [], "c": [], "o": [], "d": []})

    size = x.groupBy(F.col("c").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    per = groups.groupBy("bi", "bj").applyInPandas(sums, f"k {kind}, c long, o long, d double").groupBy("k", "c", "o").agg(F.sum("d").alias("d")).join(size, "o")
    own = F.max(F.when(F.col("c") == F.col("o"), F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1))))
    row = per.groupBy("k").agg(own.alias("a"), F.min(F.when(F.col("c") != F.col("o"), F.col("d") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    flat = x.select("c", F.posexplode("v").alias("i", "y")).groupBy("c", "i").agg((F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count(F.lit(1))).alias("e"))
    return row.agg(F.round(F.avg(s), 6).alias("silhouette")).crossJoin(flat.agg(F.round(F.sum("e"), 4).alias("inertia"), F.count_distinct("c").alias("n_clusters")))


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, c1..ck): centred projection on the first principal components; only the mean and
    the covariance (dim x dim) come to the driver."""
    x = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))

    def part(batches):
        n, s, ss = 0, None, None
        for b in batches:
            m = np.stack(b["v"]) if len(b) else None
            if m is not None:
                n, s, ss = n + len(m), m.sum(0) + (0 if s is None else s), m.T @ m + (0 if ss is None else ss)
        if s is not None:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    rows = x.select("v").mapInPandas(part, "n long, s array<double>, ss array<double>").collect()  # one row per partition
    if not rows:
        return x.select(key, *(F.lit(0.0).alias(f"c{i + 1}") for i in range(k)))
    n = sum(r["n"] for r in rows)
    mean = np.sum([r["s"] for r in rows], axis=0) / n
    d = len(mean)
    cov = np.sum([np.array(r["ss"]) for r in rows], axis=0).reshape(d, d) / n - np.outer(mean, mean)
    w, v = np.linalg.eigh(cov)
    comps = v[:, np.argsort(-w)[:k]]
    comps = comps * np.sign(comps[np.abs(comps).argmax(0), range(comps.shape[1])])
    centred = F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    return x.select(key, *(F.round(dot(centred, F.array(*map(F.lit, comps[:, i].tolist()))), 4).alias(f"c{i + 1}") for i in range(comps.shape[1])))


def coherence(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """(group, coherence): mean pairwise cosine in closed form, (|sum of unit vectors|^2 - n) /
    (n (n - 1)), so no pairs are made; groups of one are left out."""
    n = F.sqrt(dot(F.col(vector), F.col(vector)))
    u = df.where(F.col(vector).isNotNull()).select(group, *((F.col(vector)[i].cast("double") / n).alias(f"u{i}") for i in range(dim)))
    g = u.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"u{i}").alias(f"s{i}") for i in range(dim)))
    s2 = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(dim)), F.lit(0.0))
    return g.where("n > 1").select(group, ((s2 - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def walk_cooccurrence(edges: DataFrame, walks: int = 10, length: int = 20, window: int = 5, seed: int = 42) -> DataFrame:
    """(u, v, w): log1p counts of nodes within ``window`` steps on random walks.

    Every step takes the neighbour of least seeded hash, by one join and one aggregation
    for all walks at once, each step written."""
    e = edges.where("source_id <> target_id").select("source_id", "target_id")
    arcs = write_stage(e.unionByName(e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct(), "arcs").df
    cur = arcs.select(F.col("source_id").alias("at")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).withColumn("start", F.col("at")).withColumn("path", F.array("at"))
    cur = write_stage(cur, "walks").df
    for s in range(length - 1):
        j = cur.join(arcs.withColumnRenamed("source_id", "at"), "at")
        nxt = j.groupBy("start", "walk").agg(F.min(F.struct(F.xxhash64("start", "walk", F.lit(s), F.lit(seed), "target_id").alias("h"), "target_id", "path")).alias("b"))
        cur = write_stage(nxt.select("start", "walk", F.col("b.target_id").alias("at"), F.concat("b.path", F.array("b.target_id")).alias("path")), "walks").df
    at = cur.select(F.posexplode("path").alias("i", "u"), "path")
    pairs = at.select("u", F.explode(F.slice("path", F.col("i") + 2, F.lit(window))).alias("v")).where("u <> v")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).groupBy("u", "v").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("w"))


def walk_embedding(edges: DataFrame, dim: int = 16, steps: int = 6, walks: int = 10, length: int = 20, window: int = 5, seed: int = 42) -> DataFrame:
    """(id, embedding): nodes by the truncated singular value decomposition of the log1p counts of
    ``walk_cooccurrence``, left vectors times singular values, the greatest first.

    Subspace iteration: a hashed start of ``dim`` columns is multiplied by the counts, by one
    join and one aggregation a step, and made orthonormal by its Gram matrix; only that
    (dim x dim) comes to the driver. A column's sign is that of its sum."""
    w = walk_cooccurrence(edges, walks, length, window, seed)
    arcs = write_stage(w.unionByName(w.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "counts").df
    ids = arcs.select(F.col("u").alias("id")).distinct()
    n = ids.count()
    k = max(1, min(dim + EXTRA, n))  # more columns than asked for hold the last ones
    u = lambda i, part: (F.pmod(F.xxhash64("id", F.lit(i), F.lit(part), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    start = [F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * math.pi * u(i, 1)) for i in range(k)]
    cols = [f"y{i}" for i in range(k)]

    def gram(d: DataFrame, other: list[str]) -> np.ndarray:
        r = d.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in cols for b in other)).first()
        return np.array([float(x or 0.0) for x in r]).reshape(k, len(other))

    def turn(d: DataFrame, m: np.ndarray) -> DataFrame:
        return d.select("id", *(sum((F.col(c) * float(m[i, j]) for i, c in enumerate(cols)), F.lit(0.0)).alias(cols[j]) for j in range(m.shape[1])))

    def orthonormal(d: DataFrame) -> DataFrame:
        val, vec = np.linalg.eigh(gram(d, cols))
        return turn(d, vec / np.sqrt(np.maximum(val, 1e-12 * max(val.max(), 1e-300))))

    def times(d: DataFrame) -> DataFrame:
        return arcs.join(d.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in cols))

    if n == 0:
        return ids.withColumn("embedding", F.array().cast("array<double>"))
    q = write_stage(orthonormal(write_stage(ids.select("id", *(x.alias(c) for x, c in zip(start, cols))), "start").df), "basis")
    for _ in range(steps):
        y = write_stage(times(q.df), "product")
        nxt = write_stage(orthonormal(y.df), "basis")
        for s in (y, q):
            s.drop()
        q = nxt
    y = times(q.df).select("id", *(F.col(c).alias("z" + c[1:]) for c in cols))
    small = gram(q.df.join(y, "id"), ["z" + c[1:] for c in cols])
    val, vec = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(val))[: max(1, min(dim, n - 1))]
    vec = vec[:, order] * np.abs(val[order])
    total = q.df.agg(*(F.sum(c) for c in cols)).first()
    sign = np.sign(np.array([float(t) for t in total]) @ vec)
    out = turn(q.df, vec * np.where(sign == 0, 1, sign))
    return out.select("id", F.array(*(F.round(c, 6) for c in cols[: len(order)])).alias("embedding"))


def neighbour_agreement(a: DataFrame, b: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, shared): how many of the k nearest of a vector are the same in both spaces. For
    collections of up to MOST_COMPARED vectors."""
    if a.count() > MOST_COMPARED:
        raise ValueError(f"more than {MOST_COMPARED} vectors")

    def top(d: DataFrame) -> DataFrame:
        x, y = d.select(F.col(key).alias("p"), F.col(vector).alias("pv")), d.select(F.col(key).alias("q"), F.col(vector).alias("qv"))
        s = x.join(y, x["p"] != y["q"]).select("p", "q", cosine(F.col("pv"), F.col("qv")).alias("s"))
        return s.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy(F.col("s").desc(), "q"))).where(F.col("r") <= k).select("p", "q")

    both = top(a).join(top(b), ["p", "q"]).groupBy(F.col("p").alias(key)).agg(F.count(F.lit(1)).alias("shared"))
    return a.select(key).join(both, key, "left").fillna(0, ["shared"])
