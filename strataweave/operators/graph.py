"""Property-graph algebra over nodes (id, node_type, label, ...) and edges (id, source_id,
target_id, edge_type): selection, upsert, deletion, neighbourhoods, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.plans.lineage import write_stage


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key (one anti-join)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_write(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *(c for c in cols if c != order))).alias("s")).select(key, "s.*")


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id").distinct()
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


def merge_properties(old, new):
    """Property map of ``old`` overlaid with ``new``."""
    keep = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(keep, F.coalesce(new, F.create_map().cast("map<string,string>")))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes ``gone`` (id) and the edges at them."""
    n = nodes.join(gone.select("id"), "id", "left_anti")
    e = edges
    for end in ("source_id", "target_id"):
        e = e.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return n, e


def edges_of(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """Edges at a node; ``out``/``outgoing``, ``in``/``incoming`` or ``both`` (a self-loop once)."""
    s, t = F.col("source_id") == node, F.col("target_id") == node
    return edges.where({"out": s, "outgoing": s, "in": t, "incoming": t}.get(direction, s | t))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density e / (n (n - 1)), confidence range over the nodes that have one."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("node_type").alias("n_types"), F.min("confidence").alias("lo"), F.round(F.avg("confidence"), 6).alias("mean"), F.max("confidence").alias("hi"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("edge_type").alias("n_edge_types"))
    d = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    return n.crossJoin(e).withColumn("density", F.round(d, 9))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(F.count(F.lit(1)).alias("n")))


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(id, hops): nodes within ``depth`` hops of the seeds (id), with the least distance.

    Breadth-first: only the frontier is joined with the edges, and every round is written,
    so the plan doesn't grow with the depth. Edges are not collected."""
    arcs = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to"))
    if not directed:
        arcs = arcs.unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("to")))
    seen = write_stage(seeds.select("id").distinct().withColumn("hops", F.lit(0)), "hops")
    for d in range(1, depth + 1):
        frontier = seen.df.where(F.col("hops") == d - 1).select("id")
        found = arcs.join(frontier, "id", "left_semi").select(F.col("to").alias("id")).distinct().join(seen.df, "id", "left_anti").withColumn("hops", F.lit(d))
        nxt = write_stage(seen.df.unionByName(found), "hops")
        seen.drop()
        seen = nxt
    return seen.df


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops and the edges on paths of that length."""
    near = k_hop(edges, seeds, depth)
    inner = near.where(F.col("hops") < depth).select("id")
    e = edges.join(inner.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(edges.join(inner.withColumnRenamed("id", "target_id"), "target_id", "left_semi")).dropDuplicates(["id"])
    return nodes.join(near.select("id"), "id", "left_semi"), e


def to_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, p, o, literal): type, label, properties and edges as triples."""
    t = lambda d, s, p, o, lit: d.select(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(lit).alias("literal"))
    out = t(nodes, F.col("id"), F.lit("rdf:type"), F.col("node_type"), False).unionByName(t(nodes, F.col("id"), F.lit("rdfs:label"), F.col("label"), True))
    if "props" in nodes.columns:
        p = nodes.select("id", F.explode("props").alias("k", "v"))
        out = out.unionByName(t(p, F.col("id"), F.concat(F.lit(":"), "k"), F.col("v"), True))
    return out.unionByName(t(edges, F.col("source_id"), F.concat(F.lit(":"), "edge_type"), F.col("target_id"), False)).where("o is not null")


def rdf_statistics(triples: DataFrame) -> DataFrame:
    """Distinct typed subjects, and distinct subjects having another predicate."""
    typed = F.col("p") == "rdf:type"
    return triples.agg(F.count_distinct(F.when(typed, F.col("s"))).alias("n_typed"), F.count_distinct(F.when(~typed, F.col("s"))).alias("n_with_others"))


def assemble(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, skipped): entities with evidence_count, relations with known ends, and
    the number of those without."""
    ev = evidence.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence_count"), F.count_distinct("source_id").alias("n_sources"))
    nodes = entities.join(ev, "id", "left").fillna(0, ["evidence_count", "n_sources"])
    ok = with_known_ends(relations, nodes)
    skipped = relations.join(ok.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n_skipped"))
    return nodes, ok, skipped
