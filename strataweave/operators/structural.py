"""Graph metrics: centralities, components, communities, topology, statistics."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataweave.operators import whole
from strataweave.plans.lineage import materialize, write_stage
from strataweave.plans.skew import hot_keys, join_unique

#: Edges up to which a metric that needs the whole graph at once runs on the driver.
DRIVER_EDGES = 1_000_000


def simple(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: the simple undirected projection."""
    return edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree): parallel edges count, a self-loop twice."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").distinct().join(d, "id", "left").fillna(0, ["in_degree", "out_degree"]).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    part = lambda c: F.when(F.col("n") > 1, F.col(c) / (F.col("n") - 1)).otherwise(0.0)
    return d.crossJoin(F.broadcast(n)).select("id", part("degree").alias("degree"), part("in_degree").alias("in_degree"), part("out_degree").alias("out_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(id, rank) on the multigraph, dangling mass spread evenly; stops when the sum of
    changes is under n * tolerance. Each round is one join and one aggregation, written."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    w = edges.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).cast("double").alias("w"))
    out = w.groupBy("source_id").agg(F.sum("w").alias("d"))
    arcs = write_stage(join_unique(w, out, "source_id").select(F.col("source_id").alias("id"), "target_id", (F.col("w") / F.col("d")).alias("p")), "arcs")
    hot = hot_keys(arcs.df, "id")[0]
    cur = write_stage(ids.join(out.select(F.col("source_id").alias("id"), F.lit(True).alias("live")), "id", "left").withColumn("rank", F.lit(1.0 / n)), "rank")
    for _ in range(most):
        lost = cur.df.where("live is null").agg(F.sum("rank")).first()[0] or 0.0
        got = join_unique(arcs.df, cur.df.select("id", "rank"), "id", hot=hot).groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("g"))
        base = (1 - alpha) / n + alpha * lost / n
        new = cur.df.select("id", "live", F.col("rank").alias("old")).join(got, "id", "left").select("id", "live", "old", (base + alpha * F.coalesce("g", F.lit(0.0))).alias("rank"))
        nxt = write_stage(new, "rank")
        change = nxt.df.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        cur.drop()
        cur = nxt
        if change < n * tolerance:
            break
    arcs.drop()
    return cur.df.select("id", "rank")


def _power(ids: DataFrame, step, most: int, tolerance: float, name: str) -> DataFrame:
    """Power iteration: one written table a round, scaled on reading. If the sum of changes is
    not under n * tolerance after ``most`` rounds, that is an error."""
    last = write_stage(ids.withColumn("x", F.lit(1.0)), name)
    n, cur = last.df.count(), last.df
    for _ in range(most):
        raw = write_stage(step(cur), name)
        norm = raw.df.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        change = raw.df.agg(F.sum(F.abs(F.col("y") / norm - F.col("x")))).first()[0] or 0.0
        last.drop()
        last, cur = raw, raw.df.select("id", (F.col("y") / norm).alias("x"))
        if change < n * tolerance:
            return cur
    if n == 0:
        return cur
    raise RuntimeError(f"{name}: not within tolerance after {most} rounds")


def eigenvector(edges: DataFrame, most: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """(id, x): power iteration with A + I on the simple undirected graph."""
    arcs = write_stage(both_ways(simple(edges)), "arcs").df
    ids = arcs.select(F.col("u").alias("id")).distinct()

    def step(d: DataFrame) -> DataFrame:
        s = arcs.join(d.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.sum("x").alias("s"))
        return d.join(s, "id", "left").select("id", "x", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("y"))

    return _power(ids, step, most, tolerance, "eigen")


def hits(edges: DataFrame, most: int = 500, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(hubs, authorities), each summing to 1: one step is authority from hub, hub from authority."""
    w = write_stage(edges.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("w")), "arcs").df
    ids = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()

    def auth(d: DataFrame) -> DataFrame:
        return w.join(d.withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("a"))

    def step(d: DataFrame) -> DataFrame:
        h = w.join(auth(d).withColumnRenamed("id", "target_id"), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.sum(F.col("a") * F.col("w")).alias("y"))
        return d.join(h, "id", "left").select("id", "x", F.coalesce("y", F.lit(0.0)).alias("y"))

    h = _power(ids, step, most, tolerance, "hits")
    share = lambda d, c: d.crossJoin(F.broadcast(d.agg(F.sum(c).alias("t")))).select("id", F.when(F.col("t") > 0, F.col(c) / F.col("t")).otherwise(0.0).alias("x"))
    return share(h, "x"), share(ids.join(auth(h), "id", "left").fillna(0.0, ["a"]), "a")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): alternate large-star and small-star steps until no edge changes.

    Large-star links a node's greater neighbours to its least neighbour, small-star its
    smaller ones; at the end every node points at the least of its component. Groups are
    only aggregated (minimum) and joined back by key, never collected."""
    cur = write_stage(simple(edges), "stars")
    while True:
        n = cur.df.count()
        arcs = both_ways(cur.df)
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_unique(arcs, least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        one = large.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        big = write_stage(one, "stars")
        down = big.df.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = join_unique(down, small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("s")).select("s.x", "s.y")
        nxt = write_stage(linked.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "stars")
        same = nxt.df.count() == n and nxt.df.exceptAll(cur.df).isEmpty()
        big.drop()
        cur.drop()
        cur = nxt
        if same:
            break
    ids = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    if nodes is not None:
        ids = ids.unionByName(nodes.select("id")).distinct()
    up = cur.df.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return ids.join(up, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def propagate_labels(edges: DataFrame, rounds: int = 10, task_edges: int = whole.TASK_EDGES) -> DataFrame:
    """(id, community): every node takes the label most frequent around it, the least of
    equals; synchronous rounds, each written; stops when no label changes, and warns if some
    still do after the last round (labels may alternate for ever). Up to ``task_edges`` edges
    one task takes the same rounds in memory."""
    pairs = write_stage(simple(edges), "simple").df
    if pairs.count() <= task_edges:
        done = materialize(whole.in_one_task(pairs, lambda a, b, names: whole.propagate_labels(a, b, len(names), rounds), "community old", "id"), "labels")
        if not done.where("community <> old").isEmpty():
            warnings.warn(f"labels still change after {rounds} rounds", stacklevel=2)
        return done.select("id", "community")
    arcs = both_ways(pairs)
    last = write_stage(arcs.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id")), "labels")
    cur = last.df
    for _ in range(rounds):
        votes = arcs.join(cur.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id"), "community").agg(F.count(F.lit(1)).alias("c"))
        top = votes.groupBy("id").agg(F.min(F.struct((-F.col("c")).alias("n"), "community")).alias("b")).select("id", F.col("b.community").alias("new"))
        nxt = write_stage(cur.join(top, "id", "left").select("id", F.coalesce("new", "community").alias("new"), "community"), "labels")
        changed = not nxt.df.where("new <> community").isEmpty()
        last.drop()
        last, cur = nxt, nxt.df.select("id", F.col("new").alias("community"))
        if not changed:
            break
    else:
        warnings.warn(f"labels still change after {rounds} rounds", stacklevel=2)
    return cur


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: sum over communities of edges inside / m - (degree / 2m) squared."""
    e = simple(edges)
    c = lambda s: partition.select(F.col("id").alias(s), F.col("community").alias("c" + s))
    j = e.join(c("a"), "a").join(c("b"), "b")
    inside = j.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    deg = j.select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("d"))
    m = e.agg(F.count(F.lit(1)).alias("m"))
    x = deg.join(inside, "community", "left").fillna(0, ["l"]).crossJoin(F.broadcast(m))
    return x.agg(F.round(F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2.0)), 6).alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: size, density, mean degree and the Hill exponent 1 + n / sum ln d (over five positive degrees)."""
    d = degrees(nodes, edges)
    pos = F.col("degree") > 0
    x = d.agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.count(F.when(pos, 1)).alias("k"), F.sum(F.when(pos, F.log(F.col("degree").cast("double")))).alias("ln"))
    e = edges.agg(F.count(F.lit(1)).alias("e"))
    return x.crossJoin(e).select("n", "e", F.round(F.when(F.col("n") > 1, F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 9).alias("density"), F.round("mean_degree", 6).alias("mean_degree"), "max_degree", F.round(F.when((F.col("k") > 5) & (F.col("ln") > 0), 1 + F.col("k") / F.col("ln")), 6).alias("hill_exponent"))


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): edges directed from the lower to the higher (degree, id), wedges at
    their low end joined with closing edges: no node has more than the root of 2m of them."""
    e = write_stage(simple(edges), "simple").df
    deg = both_ways(e).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    k = lambda s: deg.select(F.col("id").alias(s), F.col("d").alias("d" + s))
    j = e.join(k("a"), "a").join(k("b"), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = write_stage(j.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")), "oriented").df
    p, q = o.select("x", F.col("y").alias("y")), o.select("x", F.col("y").alias("z"))
    wedge = p.join(q, "x").where("y < z")
    t = wedge.join(e.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    return t.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: mean local clustering over all nodes, and transitivity (closed / all wedges)."""
    e = simple(edges)
    deg = both_ways(e).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    x = nodes.select("id").distinct().join(deg, "id", "left").join(triangles(edges), "id", "left").fillna(0, ["d", "triangles"])
    wedges = F.col("d") * (F.col("d") - 1) / 2
    return x.agg(F.round(F.avg(F.when(wedges > 0, F.col("triangles") / wedges).otherwise(0.0)), 6).alias("mean_clustering"), F.round(F.when(F.sum(wedges) > 0, F.sum("triangles") / F.sum(wedges)).otherwise(0.0), 6).alias("transitivity"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of distinct directed edges that have a reverse."""
    e = edges.where("source_id <> target_id").select("source_id", "target_id").distinct()
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit(1).alias("r"))
    return e.join(back, ["source_id", "target_id"], "left").agg(F.round(F.coalesce(F.sum("r") / F.count(F.lit(1)), F.lit(0.0)), 6).alias("reciprocity"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Pearson correlation of the degrees at the ends of the simple undirected edges, both ways."""
    arcs = both_ways(simple(edges))
    deg = arcs.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    k = lambda s: deg.select(F.col("id").alias(s), F.col("d").alias("d" + s))
    return arcs.join(k("u"), "u").join(k("v"), "v").agg(F.round(F.corr("du", "dv"), 6).alias("assortativity"))


def centrality_summary(values: DataFrame, col: str) -> DataFrame:
    """One row: mean, population deviation, maximum and Gini coefficient. Ranks come from the
    histogram of values, so no sort of all rows in one task."""
    h = values.groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(W.orderBy("x")))
    a = F.col("upto") - F.col("c")
    ranks = F.col("c") * a + F.col("c") * (F.col("c") + 1) / 2  # sum of the ranks of the equal values
    g = h.agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("s"), F.sum(F.col("x") * F.col("x") * F.col("c")).alias("s2"), F.max("x").alias("hi"), F.sum(F.col("x") * ranks).alias("w"))
    mean = F.col("s") / F.col("n")
    return g.select("n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)), 5).alias("std"), F.round("hi", 6).alias("hi"), F.round(F.when(F.col("s") > 0, 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0), 6).alias("gini"))


def entropy_of(counts: Column, total: Column) -> Column:
    p = counts / total
    return -F.sum(p * F.log(p))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: normalised mutual information (arithmetic mean) of two labellings."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    n = joint.agg(F.sum("c").alias("n"))
    side = lambda s: joint.groupBy(s).agg(F.sum("c").alias("k")).crossJoin(F.broadcast(n)).agg(entropy_of(F.col("k"), F.col("n")).alias("h" + s))
    hj = joint.crossJoin(F.broadcast(n)).agg(entropy_of(F.col("c"), F.col("n")).alias("hj"))
    x = side("a").crossJoin(side("b")).crossJoin(hj)
    return x.select(F.round(F.when(F.col("ha") + F.col("hb") > 0, 2 * (F.col("ha") + F.col("hb") - F.col("hj")) / (F.col("ha") + F.col("hb"))).otherwise(1.0), 6).alias("nmi"))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two labellings from their contingency table."""
    c2 = lambda c: c * (c - 1) / 2
    joint = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    s = joint.agg(F.sum(c2(F.col("c"))).alias("sij"), F.sum("c").alias("n"))
    sa = joint.groupBy("a").agg(F.sum("c").alias("k")).agg(F.sum(c2(F.col("k"))).alias("sa"))
    sb = joint.groupBy("b").agg(F.sum("c").alias("k")).agg(F.sum(c2(F.col("k"))).alias("sb"))
    x = s.crossJoin(sa).crossJoin(sb)
    want, top = F.col("sa") * F.col("sb") / c2(F.col("n")), (F.col("sa") + F.col("sb")) / 2
    return x.select(F.round(F.when(top == want, 1.0).otherwise((F.col("sij") - want) / (top - want)), 6).alias("ari"))


def type_degree_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges).join(nodes.select("id", "node_type"), "id")
    return d.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("degree"), 6).alias("mean"), F.round(F.percentile("degree", 0.5), 6).alias("median"), F.round(F.stddev_pop("degree"), 6).alias("std"), F.min("degree").alias("lo"), F.max("degree").alias("hi"))


def metric_snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: share of typed nodes, orphans, mean and largest degree, hubs (over twice the mean), nodes without a label."""
    d = degrees(nodes, edges).join(nodes.select("id", "node_type", "label"), "id")
    mean = d.agg(F.avg("degree").alias("m"))
    x = d.crossJoin(F.broadcast(mean))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(blank("node_type"), 0.0).otherwise(1.0)), 6).alias("typed"), F.count(F.when(F.col("degree") == 0, 1)).alias("orphans"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"), F.count(F.when(F.col("degree") > 2 * F.col("m"), 1)).alias("hubs"), F.count(F.when(blank("label"), 1)).alias("unlabelled"))


def _adjacency(edges: DataFrame) -> tuple[list[str], list[list[int]]]:
    """The simple graph on the driver; more than DRIVER_EDGES edges are refused."""
    e = simple(edges)
    if e.count() > DRIVER_EDGES:
        raise ValueError(f"more than {DRIVER_EDGES} edges")
    p = e.toPandas()
    codes, names = pd.factorize(pd.concat([p["a"], p["b"]]), sort=True)
    n, m = len(names), len(p)
    adj: list[list[int]] = [[] for _ in range(n)]
    for x, y in zip(codes[:m], codes[m:]):
        adj[x].append(y)
        adj[y].append(x)
    return list(names), adj


def _sources(spark, n: int, per: int = 64) -> DataFrame:
    return spark.range(0, n, 1, max(1, -(-n // per)))


#: Pairs of a source and a node that a task follows at once.
PATH_PAIRS = 1_000_000


def path_centralities(edges: DataFrame) -> DataFrame:
    """(id, betweenness, closeness), normalised: a breadth-first search from every node (Brandes),
    many in step as arrays, sources spread over the cluster, the adjacency sent once. For
    graphs of up to DRIVER_EDGES edges."""
    names, adj = _adjacency(edges)
    n = len(names)
    spark = edges.sparkSession
    if n == 0:
        return spark.createDataFrame([], "id string, betweenness double, closeness double")
    size = np.array([len(x) for x in adj])
    shared = spark.sparkContext.broadcast((np.concatenate([[0], np.cumsum(size)]).astype(np.int32), np.concatenate(adj).astype(np.int32)))
    step = max(1, min(64, PATH_PAIRS // n))

    def run(batches):
        start, beside = shared.value
        n = len(start) - 1
        total, ids, close = np.zeros(n), [], []
        for x in batches:
            for s in range(0, len(x), step):
                sources = x["id"].to_numpy()[s : s + step]
                through, far, met = whole.shortest_paths(start, beside, sources)
                total += through
                ids.append(sources)
                close.append(np.where(far > 0, met / np.maximum(far, 1) * (met / (n - 1)), 0.0))
        at, own = np.flatnonzero(total), np.concatenate([*ids, np.zeros(0, np.int64)])
        yield pd.DataFrame({"i": np.concatenate([at, own]), "b": np.concatenate([total[at], np.zeros(len(own))]), "c": np.concatenate([np.zeros(len(at)), *close])})

    # a task returns a row for each node that lies on a path, so there are few tasks
    tasks = max(1, min(-(-n // 64), 8 * spark.sparkContext.defaultParallelism))
    parts = spark.range(0, n, 1, tasks).mapInPandas(run, "i long, b double, c double").groupBy("i").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    norm = (n - 1) * (n - 2) if n > 2 else 1
    ids = spark.createDataFrame(pd.DataFrame({"i": range(n), "id": names}))
    return ids.join(parts, "i").select("id", (F.col("b") / norm).alias("betweenness"), F.col("c").alias("closeness"))


def path_lengths(edges: DataFrame) -> DataFrame:
    """One row for the largest component: n, diameter and mean shortest path, over all its sources."""
    names, adj = _adjacency(edges)
    seen, best = set(), []
    for s in range(len(adj)):
        if s not in seen:
            comp, todo = {s}, [s]
            while todo:
                for w in adj[todo.pop()]:
                    if w not in comp:
                        comp.add(w)
                        todo.append(w)
            seen |= comp
            if len(comp) > len(best):
                best = sorted(comp)
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast((adj, best))

    def run(batches):
        adj, own = shared.value
        hi, total = 0, 0
        for x in batches:
            for i in x["id"]:
                dist, level = {own[i]: 0}, [own[i]]
                while level:
                    nxt = []
                    for v in level:
                        for w in adj[v]:
                            if w not in dist:
                                dist[w] = dist[v] + 1
                                nxt.append(w)
                    level = nxt
                hi, total = max(hi, max(dist.values())), total + sum(dist.values())
        yield pd.DataFrame({"hi": [hi], "total": [total]})

    n = len(best)
    r = _sources(spark, n).mapInPandas(run, "hi long, total long")
    return r.agg(F.lit(n).alias("n"), F.max("hi").alias("diameter"), F.round(F.sum("total") / max(1, n * (n - 1)), 6).alias("mean_path"))


def bridges(edges: DataFrame, most: int = 50) -> DataFrame:
    """(a, b): the first ``most`` bridges in order; Tarjan's search on the driver."""
    names, adj = _adjacency(edges)
    low, num, out, clock = {}, {}, [], 0
    for root in range(len(adj)):
        if root in num:
            continue
        stack = [(root, -1, iter(adj[root]))]
        num[root] = low[root] = clock
        clock += 1
        while stack:
            v, parent, it = stack[-1]
            for w in it:
                if w == parent:
                    continue
                if w in num:
                    low[v] = min(low[v], num[w])
                else:
                    num[w] = low[w] = clock
                    clock += 1
                    stack.append((w, v, iter(adj[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > num[u]:
                        out.append(tuple(sorted((names[u], names[v]))))
    return edges.sparkSession.createDataFrame(sorted(out)[:most], "a string, b string")


def non_backtracking(edges: DataFrame, rounds: int = 500, tolerance: float = 1e-9, task_edges: int = whole.TASK_EDGES) -> DataFrame:
    """(id, x): leading eigenvector of the non-backtracking matrix summed by edge source, the
    greatest scaled to 1. The step uses sums by node less the reverse edge, so its cost is
    the number of edges, not of edge pairs. Up to ``task_edges`` edges one task runs Arnoldi's
    method; beyond, each round of the power iteration is written. If it isn't within
    ``tolerance``, relative to the vector, after ``rounds`` rounds, that is an error."""
    pairs = write_stage(simple(edges), "simple").df
    m = pairs.count()
    if m <= task_edges:
        done = materialize(whole.in_one_task(pairs, lambda a, b, names: whole.non_backtracking(a, b, len(names), rounds, tolerance), "x", "double"), "nb")
        if not done.where(F.isnan("x")).isEmpty():
            raise RuntimeError(f"nb: not within tolerance after {rounds} rounds")
        return done
    n = pairs.select(F.explode(F.array("a", "b")).alias("id")).agg(F.count_distinct("id")).first()[0]
    if m == n - components(pairs.selectExpr("a as source_id", "b as target_id")).agg(F.count_distinct("component")).first()[0]:
        return both_ways(pairs).select(F.col("u").alias("id")).distinct().withColumn("x", F.lit(0.0))  # trees have no other eigenvalue than 0
    last = write_stage(both_ways(pairs).withColumn("x", F.lit(1.0)), "nb")
    cur = last.df
    for _ in range(rounds):
        into = cur.groupBy(F.col("u").alias("v")).agg(F.sum("x").alias("s"))
        rev = cur.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("x").alias("r"))
        # the matrix and 1: other eigenvalues may be as large as the first, but not with 1 added
        raw = write_stage(cur.join(into, "v").join(rev, ["u", "v"]).select("u", "v", "x", (F.col("s") - F.col("r") + F.col("x")).alias("y")), "nb")
        norm = raw.df.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        last.drop()
        change, all_ = raw.df.agg(F.sum(F.abs(F.col("y") / norm - F.col("x"))), F.sum("x")).first()
        last, cur = raw, raw.df.select("u", "v", (F.col("y") / norm).alias("x"))
        if change <= all_ * tolerance:
            break
    else:
        raise RuntimeError(f"nb: not within tolerance after {rounds} rounds")
    s = cur.groupBy(F.col("u").alias("id")).agg(F.sum("x").alias("x"))
    return s.crossJoin(F.broadcast(s.agg(F.max("x").alias("m")))).select("id", F.when(F.col("m") > 0, F.col("x") / F.col("m")).otherwise(0.0).alias("x"))


def power_law(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: exponent and Kolmogorov-Smirnov distance of the discrete power law at the best
    lower cut-off, plausible if under .1; fewer than ten positive degrees give none. Only
    the degree histogram comes to the driver."""
    h = degrees(nodes, edges).where("degree > 0").groupBy("degree").agg(F.count(F.lit(1)).alias("c")).orderBy("degree").toPandas()
    spark = nodes.sparkSession
    out = "alpha double, xmin long, ks_d double, plausible boolean"
    if len(h) == 0 or h["c"].sum() < 10:
        return spark.createDataFrame([], out)
    d, c = h["degree"].to_numpy(float), h["c"].to_numpy(float)
    best = None
    for i in range(max(1, len(d) - 1)):
        x, w = d[i:], c[i:]
        if w.sum() < 10:
            break
        s = (w * np.log(x / (d[i] - 0.5))).sum()
        if s <= 0:
            continue
        a = 1 + w.sum() / s
        grid = np.arange(d[i], d[-1] + 1)
        p = grid**-a
        cdf = np.cumsum(p) / p.sum()
        ks = np.abs(np.cumsum(w) / w.sum() - cdf[(x - d[i]).astype(int)]).max()
        if best is None or ks < best[2]:
            best = (float(round(a, 6)), int(d[i]), float(round(ks, 6)), bool(ks < 0.1))
    return spark.createDataFrame([best] if best else [], out)


def bootstrap_density(edges: DataFrame, trials: int = 100, seed: int = 42) -> DataFrame:
    """One row: 95 % interval of the mean degree under edge resampling. Poisson weights per
    edge and trial from a hash replace drawing with replacement, so edges are read once."""
    e = simple(edges).select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    u = (F.pmod(F.xxhash64("a", "b", "trial", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    w = sum((F.when(u > p, 1).otherwise(0) for p in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)), F.lit(0))
    t = e.withColumn("w", w).groupBy("trial").agg(F.sum("w").alias("m"))
    n = both_ways(simple(edges)).agg(F.count_distinct("u").alias("n"))
    x = t.crossJoin(F.broadcast(n)).withColumn("k", 2 * F.col("m") / F.col("n"))
    return x.agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg("k"), 6).alias("mean"), F.round(F.stddev_pop("k"), 6).alias("std"), F.round(F.percentile("k", 0.025), 6).alias("lo"), F.round(F.percentile("k", 0.975), 6).alias("hi"))


def _trial_frame(spark, trials: int) -> DataFrame:
    return spark.range(0, trials, 1, min(trials, 32))


def baseline_modularity(edges: DataFrame, partition: DataFrame, trials: int = 100, seed: int = 42) -> DataFrame:
    """One row: observed modularity, mean and deviation under the configuration model, z and
    empirical p. Trials run as rows; each shuffles the stubs of the community degrees."""
    obs = modularity(edges, partition).first()["modularity"] or 0.0
    e = simple(edges)
    if e.count() > DRIVER_EDGES:
        raise ValueError(f"more than {DRIVER_EDGES} edges")
    deg = both_ways(e).join(partition.select(F.col("id").alias("u"), "community"), "u").groupBy("community").agg(F.count(F.lit(1)).alias("d")).toPandas()
    d = deg["d"].to_numpy()
    stubs = np.repeat(np.arange(len(d)), d)
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast((stubs, d))

    def run(batches):
        stubs, d = shared.value
        m = max(1, len(stubs) // 2)
        for x in batches:
            q = []
            for t in x["id"]:
                s = np.random.default_rng(seed + int(t)).permutation(stubs)
                q.append(float((s[: 2 * m : 2] == s[1 : 2 * m : 2]).sum() / m - ((d / (2 * m)) ** 2).sum()))
            yield pd.DataFrame({"q": q})

    r = _trial_frame(spark, trials).mapInPandas(run, "q double")
    return r.agg(F.lit(float(obs)).alias("observed"), F.round(F.avg("q"), 6).alias("mean"), F.round(F.stddev_pop("q"), 6).alias("std"), F.round((F.lit(float(obs)) - F.avg("q")) / F.stddev_pop("q"), 4).alias("z"), F.round(F.avg((F.col("q") >= float(obs)).cast("int")), 6).alias("p"))


def small_world(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sigma = (C / C_random) / (L / L_random) with the closed forms of a random graph
    of the same size, C = k/n and L = ln n / ln k."""
    c = clustering(nodes, edges)
    l_ = path_lengths(edges)
    t = topology(nodes, simple(edges).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("e").alias("edge_type")))
    x = c.crossJoin(l_.select("mean_path")).crossJoin(t.select("n", "mean_degree"))
    cr, lr = F.col("mean_degree") / F.col("n"), F.log(F.col("n").cast("double")) / F.log("mean_degree")
    return x.select("mean_clustering", "mean_path", F.round(F.when((F.col("mean_path") > 0) & (F.col("mean_degree") > 1), (F.col("mean_clustering") / cr) / (F.col("mean_path") / lr)), 6).alias("sigma"))


def small_world_sampled(nodes: DataFrame, edges: DataFrame, graphs: int = 10, seed: int = 42, least: int = 4, most: int = 10_000) -> DataFrame:
    """One row: sigma = (C / C_random) / (L / L_random), with the means of ``graphs`` random graphs
    of as many nodes and edges. They are drawn and measured on the executors, one a row. For
    ``least`` to ``most`` nodes; else no row."""
    c = clustering(nodes, edges).first()["mean_clustering"]
    l_ = path_lengths(edges).first()
    n, m = nodes.select("id").distinct().count(), simple(edges).count()
    spark, out = nodes.sparkSession, "mean_clustering double, mean_path double, random_clustering double, random_path double, sigma double"
    if not least <= n <= most or l_ is None or not m:
        return spark.createDataFrame([], out)

    def run(batches):
        for x in batches:
            got = []
            for t in x["id"]:
                rng, links = np.random.default_rng(seed + int(t)), set()
                while len(links) < min(m, n * (n - 1) // 2):
                    for a, b in np.sort(rng.integers(0, n, (m - len(links) + 8, 2)), axis=1).tolist():
                        if a != b and len(links) < m:
                            links.add((a, b))
                beside: list[set[int]] = [set() for _ in range(n)]
                for a, b in links:
                    beside[a].add(b)
                    beside[b].add(a)
                local = [2 * sum(len(beside[v] & s) for v in s) / 2 / (len(s) * (len(s) - 1)) if len(s) > 1 else 0.0 for s in beside]
                total = pairs = 0
                for start in range(n):
                    seen, level, d = {start}, [start], 0
                    while level:
                        d += 1
                        level = [v for v in set().union(*(beside[u] for u in level)) if v not in seen]
                        seen.update(level)
                        total += d * len(level)
                        pairs += len(level)
                got.append((float(np.mean(local)), total / pairs if pairs else 0.0))
            yield pd.DataFrame(got, columns=["c", "l"])

    r = _trial_frame(spark, graphs).mapInPandas(run, "c double, l double").agg(F.avg("c").alias("c"), F.avg("l").alias("l")).first()
    path = l_["mean_path"]
    sigma = (c / r["c"]) / (path / r["l"]) if r["c"] and r["l"] and path else None
    return spark.createDataFrame([(float(c), float(path), round(r["c"], 6), round(r["l"], 6), None if sigma is None else round(float(sigma), 6))], out)


#: What a pass over all nodes must add to the modularity for the passes to go on.
LEAST_GAIN = 1e-6


def louvain(edges: DataFrame, task_edges: int = whole.TASK_EDGES) -> DataFrame:
    """(id, community): communities by Louvain's two phases.

    Every node looks at the communities around it and moves to the one of the greatest gain
    of modularity, the least of equals; in a round only half of the nodes move, chosen by a
    hash, so two neighbours seldom change places. When a pass over both halves adds less than
    LEAST_GAIN, communities become the nodes of a smaller graph and the moves start again,
    until that adds nothing. Rounds are written; only sums over all nodes come to the driver.
    Up to ``task_edges`` edges one task takes the same steps in memory.
    A community is named by its least node; self-loops and repeated edges don't count."""
    pairs = write_stage(simple(edges), "simple").df
    if pairs.count() <= task_edges:
        return materialize(whole.in_one_task(pairs, lambda a, b, names: whole.louvain(a, b, len(names), whole.marks(names), LEAST_GAIN), "community", "id"), "communities")
    arcs = write_stage(both_ways(pairs).withColumn("w", F.lit(1.0)), "arcs")
    m2 = arcs.df.agg(F.sum("w")).first()[0]
    ids = write_stage(arcs.df.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id")), "communities")
    if not m2:
        return ids.df
    best = -1.0
    while True:
        deg = write_stage(arcs.df.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")), "moves")
        first, last, turn = best, best, 0
        while True:
            for half in (0, 1):
                d = deg.df
                own = d.select(F.col("id").alias("u"), "k", F.col("c").alias("mine"))
                total = d.groupBy("c").agg(F.sum("k").alias("t"))
                near = arcs.df.where("u <> v").join(d.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
                seen = near.unionByName(d.select(F.col("id").alias("u"), "c", F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
                gain = F.round(F.col("w") - F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / m2, 9)
                scored = seen.join(own, "u").join(total, "c").withColumn("g", gain)
                top = scored.groupBy(F.col("u").alias("id")).agg(F.min(F.struct((-F.col("g")).alias("g"), "c")).alias("b"), F.max(F.when(F.col("c") == F.col("mine"), F.col("g"))).alias("stay"))
                turn_now = F.shiftright(F.crc32(F.col("id").cast("string")), turn // 2 % 32).bitwiseAND(F.lit(1)) == half
                new = d.join(top, "id").select("id", "k", F.when(turn_now & (-F.col("b.g") > F.col("stay")), F.col("b.c")).otherwise(F.col("c")).alias("c"))
                nxt = write_stage(new, "moves")
                deg.drop()
                deg, turn = nxt, turn + 1
            c = deg.df.select("id", "c")
            inside = arcs.df.join(c.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(c.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").agg(F.sum("w")).first()[0] or 0.0
            square = deg.df.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum((F.col("t") / m2) ** 2)).first()[0]
            q = inside / m2 - square
            if q <= last + LEAST_GAIN:
                break
            last = q
        best = max(q, last)
        if best <= first + LEAST_GAIN:
            break
        names = deg.df.groupBy("c").agg(F.min("id").alias("name"))
        to = write_stage(deg.df.join(names, "c").select(F.col("id").alias("community"), "name"), "names")
        new_ids = write_stage(ids.df.join(to.df, "community").select("id", F.col("name").alias("community")), "communities")
        short = arcs.df.join(to.df.select(F.col("community").alias("u"), F.col("name").alias("a")), "u").join(to.df.select(F.col("community").alias("v"), F.col("name").alias("b")), "v")
        new_arcs = write_stage(short.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), "arcs")
        for s in (arcs, ids, to):
            s.drop()
        arcs, ids = new_arcs, new_ids
    return ids.df.join(ids.df.groupBy("community").agg(F.min("id").alias("least")), "community").select("id", F.col("least").alias("community"))


def greedy_modularity(edges: DataFrame, task_edges: int = whole.TASK_EDGES) -> DataFrame:
    """(id, community): communities merge with the neighbour of the greatest gain of modularity,
    all pairs that are each other's best in one round, until no merge would gain. A community
    is named by its least node; self-loops and repeated edges don't count. Up to
    ``task_edges`` edges one task takes the same steps in memory."""
    pairs = write_stage(simple(edges), "simple").df
    if pairs.count() <= task_edges:
        return materialize(whole.in_one_task(pairs, lambda a, b, names: whole.greedy_modularity(a, b, len(names)), "community", "id"), "communities")
    arcs = write_stage(both_ways(pairs).withColumn("w", F.lit(1.0)), "arcs")
    m2 = arcs.df.agg(F.sum("w")).first()[0]
    ids = write_stage(arcs.df.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id")), "communities")
    while m2:
        share = arcs.df.groupBy("u").agg((F.sum("w") / m2).alias("a"))
        pairs = arcs.df.where("u <> v").join(share, "u").join(share.select(F.col("u").alias("v"), F.col("a").alias("b")), "v")
        gain = pairs.select("u", "v", F.round(F.col("w") / m2 - F.col("a") * F.col("b"), 12).alias("g")).where("g > 0")
        # the order of a pair's equals is the same seen from both ends
        pick = gain.groupBy("u").agg(F.min(F.struct((-F.col("g")).alias("g"), F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "v")).alias("b")).select("u", F.col("b.v").alias("v"))
        pick = write_stage(pick, "picks")
        both = pick.df.join(pick.df.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]).where("u < v").select(F.col("v").alias("community"), F.col("u").alias("name"))
        merged = write_stage(both, "merges")
        pick.drop()
        if merged.df.isEmpty():
            break
        to = lambda d, c: d.join(merged.df.select(F.col("community").alias(c), F.col("name").alias(c + "2")), c, "left").withColumn(c, F.coalesce(c + "2", c)).drop(c + "2")
        new_ids = write_stage(to(ids.df, "community"), "communities")
        new_arcs = write_stage(to(to(arcs.df, "u"), "v").groupBy("u", "v").agg(F.sum("w").alias("w")), "arcs")
        for s in (arcs, ids, merged):
            s.drop()
        arcs, ids = new_arcs, new_ids
    return ids.df.select("id", "community")
