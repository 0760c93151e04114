"""Ontology reading, materialisation of implied edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.plans.lineage import write_stage


def hierarchy_depth(pairs: DataFrame, most: int = 64) -> DataFrame:
    """(class, depth): longest chain of parents, over (child, parent) pairs. Cycles stop at ``most``."""
    p = pairs.select("child", "parent").where("parent is not null").distinct()
    every = p.select(F.explode(F.array("child", "parent")).alias("class")).distinct()
    cur = write_stage(every.join(p.select(F.col("child").alias("class")).distinct(), "class", "left_anti").withColumn("depth", F.lit(0)), "depth")
    best = cur.df
    for d in range(1, most + 1):
        nxt = write_stage(p.join(cur.df.select(F.col("class").alias("parent")), "parent").select(F.col("child").alias("class")).distinct().withColumn("depth", F.lit(d)), "depth")
        if nxt.df.isEmpty():
            break
        best, cur = best.unionByName(nxt.df), nxt
    return every.join(best.groupBy("class").agg(F.max("depth").alias("depth")), "class", "left").fillna(0, ["depth"])


def missing_reverse(edges: DataFrame, types: list[str], inverse: str | None = None) -> DataFrame:
    """Reverse edges that the symmetric (or inverse) property implies and that aren't there."""
    e = edges.where(F.col("edge_type").isin(types)).select("source_id", "target_id", "edge_type").distinct()
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit(inverse).alias("edge_type") if inverse else F.col("edge_type")).distinct()
    return back.join(edges.select("source_id", "target_id", "edge_type").distinct(), ["source_id", "target_id", "edge_type"], "left_anti")


def materialise_inverse(edges: DataFrame, p: str, q: str) -> DataFrame:
    """New edges of p's and q's being inverses: first q from p, then p from q, the second
    pass seeing the first."""
    first = missing_reverse(edges, [p], q)
    cols = ["source_id", "target_id", "edge_type"]
    return first.unionByName(missing_reverse(edges.select(*cols).unionByName(first), [q], p)).distinct()


def materialise_transitive(edges: DataFrame, kind: str, closure: bool = False, most: int = 64) -> DataFrame:
    """New edges a-c for a-b-c without a-c, a other than c: one pass, or until no more come.

    The closure squares the relation each round (pairs join pairs), so the rounds are the
    logarithm of the longest path; each is written."""
    base = edges.where(F.col("edge_type") == kind).select("source_id", "target_id").distinct()

    def step(d: DataFrame) -> DataFrame:
        a, b = d.select("source_id", F.col("target_id").alias("m")), d.select(F.col("source_id").alias("m"), "target_id")
        return a.join(b, "m").where("source_id <> target_id").select("source_id", "target_id").distinct().join(d, ["source_id", "target_id"], "left_anti")

    if not closure:
        return step(base).withColumn("edge_type", F.lit(kind))
    cur = write_stage(base, "closure")
    for _ in range(most):
        new = write_stage(step(cur.df), "closure")
        if new.df.isEmpty():
            break
        cur = write_stage(cur.df.unionByName(new.df), "closure")
    return cur.df.join(base, ["source_id", "target_id"], "left_anti").withColumn("edge_type", F.lit(kind))


def materialise_classes(nodes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(id, node_type) labels that parent classes add, the pairs (child, parent) being applied in order."""
    types = nodes.select("id", "node_type").distinct()
    added = None
    for child, parent in pairs:
        have = types if added is None else types.unionByName(added)
        new = have.where(F.col("node_type") == child).select("id", F.lit(parent).alias("node_type")).distinct().join(have, ["id", "node_type"], "left_anti")
        added = new if added is None else added.unionByName(new)
    return added


def full_inference(edges: DataFrame, symmetric: list[str], inverses: list[tuple[str, str]], transitive: list[str]) -> DataFrame:
    """All edges that symmetric, inverse and transitive properties add, in this order."""
    cols = ["source_id", "target_id", "edge_type"]
    base = have = edges.select(*cols).distinct()
    have = write_stage(have.unionByName(missing_reverse(have, symmetric)), "inference").df
    for p, q in inverses:
        have = write_stage(have.unionByName(materialise_inverse(have, p, q)).distinct(), "inference").df
    for k in transitive:
        have = write_stage(have.unionByName(materialise_transitive(have, k).select(*cols)), "inference").df
    return have.join(base, cols, "left_anti")
