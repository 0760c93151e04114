"""Consolidating pairwise matches into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import norm
from strataweave.plans.lineage import Stage, write_stage
from strataweave.plans.skew import hot_keys, join_unique


def link_groups(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, group_id): the smallest node reachable over ``edges``, for each node in them.

    Minimum labels are propagated over the edges of a graph that shrinks: each round
    takes for every node the least node beside it (one map-side combined aggregation,
    so a node in any share of the edges is cheap), jumps pointers twice, and rewrites
    the edges between the labels. Every round is written to the shared folder. It ends
    when no edge joins two labels, that is, when no label would change. Rows with a
    null end are left out; self-loops make a group of one; repeats count once; no
    edges give an empty table.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    all_nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cur = write_stage(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = write_stage(all_nodes.withColumn("label", F.col("node")), "labels")
    old: list[Stage] = []
    while not cur.df.isEmpty():
        both = cur.df.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x"))
        parent = write_stage(both.groupBy("x.v").agg(F.min("x.u").alias("u")).select("v", F.least("v", "u").alias("p")), "parent")
        for _ in range(2):  # pointer jumping
            up = parent.df.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent, done = write_stage(join_unique(parent.df, up, "p").select("v", F.col("pp").alias("p")), "parent"), parent
            old.append(done)
        hot_a, hot_b = hot_keys(cur.df, "a", "b")
        moved = join_unique(cur.df, parent.df.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a", hot=hot_a)
        moved = join_unique(moved, parent.df.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b", hot=hot_b)
        nxt = write_stage(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        lifted = join_unique(label.df, parent.df.select(F.col("v").alias("label"), F.col("p").alias("up")), "label", "left")
        new = write_stage(lifted.select("node", F.coalesce("up", "label").alias("label")), "labels")
        old += [cur, label, parent]
        cur, label = nxt, new
        for s in old:
            s.drop()
        old = []
    cur.drop()
    return label.df.select("node", F.col("label").alias("group_id"))


def candidate_edges(candidates: DataFrame, min_score: float = 0.85, ids: str = "ids", score: str = "score") -> DataFrame:
    """(src, dst) from the least id of each counting candidate to its other ids.

    A candidate counts if its score is a number of at least ``min_score`` and it names
    two or more different ids, compared trimmed and in lower case; null ids are left
    out. A star per candidate, so never all pairs of its ids. Null or empty id lists
    and null or NaN scores don't count; extra columns are not read.
    """
    clean = F.array_sort(F.array_distinct(F.transform(F.filter(F.col(ids), lambda x: x.isNotNull()), norm)))
    c = candidates.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) >= min_score)).select(clean.alias("x")).where("size(x) >= 2")
    return c.select(F.element_at("x", 1).alias("src"), F.explode(F.slice("x", 2, F.size("x") - 1)).alias("dst"))
