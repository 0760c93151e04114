"""Rules, consistency, shape checks and quality scores over nodes and edges."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of types that exclude one another; properties with a single value.
INCOMPATIBLE = (("Person", "Organization"), ("Person", "Location"), ("Organization", "Location"))
SINGLE_VALUED = ("birthDate", "deathDate", "foundedDate", "capital", "population")
# Weights of the quality score, and the number of violations at which its shape part is 0.
WEIGHTS = {"consistency": 0.30, "acceptance": 0.20, "coverage": 0.15, "shacl": 0.35}
MOST_VIOLATIONS = 200
#: Concepts that label inclusion may be tested against.
MOST_CONCEPTS = 100_000


def inverse_violations(edges: DataFrame, p: str, q: str) -> DataFrame:
    """Edges of p without the reverse edge of q."""
    back = edges.where(F.col("edge_type") == q).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")).distinct()
    return edges.where(F.col("edge_type") == p).join(back, ["source_id", "target_id"], "left_anti").select("source_id", F.lit(p).alias("edge_type"), "target_id")


def transitive_violations(edges: DataFrame, p: str) -> DataFrame:
    """Two-hop paths a-b-c without an edge a-c; one row per path."""
    e = edges.where(F.col("edge_type") == p)
    a, b = e.select("source_id", F.col("target_id").alias("m")), e.select(F.col("source_id").alias("m"), "target_id")
    return a.join(b, "m").join(e.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti").select("source_id", F.lit(p).alias("edge_type"), "target_id")


def domain_range_violations(edges: DataFrame, nodes: DataFrame, p: str, domain: list[str], range_: list[str]) -> DataFrame:
    """An edge end of a type that isn't listed; a missing node or an empty list passes; up to two rows an edge."""
    e = edges.where(F.col("edge_type") == p)
    out = None
    for end, allowed in (("source_id", domain), ("target_id", range_)):
        if allowed:
            bad = e.join(nodes.select(F.col("id").alias(end), "node_type"), end).where(~F.col("node_type").isin(allowed)).select("id", F.lit(end).alias("end"), "node_type")
            out = bad if out is None else out.unionByName(bad)
    return out


def functional_violations(edges: DataFrame, p: str, order: str = "id") -> DataFrame:
    """All edges of p but the first of their source.

    The first comes from an aggregation that is joined back, so no source is sorted whole."""
    e = edges.where(F.col("edge_type") == p)
    first = e.groupBy("source_id").agg(F.min(order).alias("__first"))
    return e.join(first, "source_id").where(F.col(order) != F.col("__first")).select("id", "source_id", "target_id")


def type_conflicts(types: DataFrame) -> DataFrame:
    """(id, a, b): ordered pairs of incompatible types of a node, over (id, node_type)."""
    pairs = types.sparkSession.createDataFrame([x for a, b in INCOMPATIBLE for x in ((a, b), (b, a))], "a string, b string")
    t = types.distinct()
    return t.withColumnRenamed("node_type", "a").join(F.broadcast(pairs), "a").join(t.withColumnRenamed("node_type", "b"), ["id", "b"], "left_semi").select("id", "a", "b")


def value_conflicts(values: DataFrame) -> DataFrame:
    """(id, key, n): properties with more than one distinct non-null value."""
    return values.where("value is not null").groupBy("id", "key").agg(F.count_distinct("value").alias("n")).where("n > 1")


def cardinality_conflicts(values: DataFrame, single: tuple[str, ...] = SINGLE_VALUED) -> DataFrame:
    return values.where(F.col("key").isin(*single)).groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicts_of(values: DataFrame, node: str) -> DataFrame:
    """Other nodes of the type of ``node`` with another non-null value of a shared property."""
    mine = values.where((F.col("id") == node) & F.col("value").isNotNull()).select("node_type", "key", F.col("value").alias("mine"))
    return values.where((F.col("id") != node) & F.col("value").isNotNull()).join(mine, ["node_type", "key"]).where("value <> mine").select("id", "key", "value", "mine")


def shape_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, severity, reason): id and type are required, a label is wanted, and an
    edge's confidence is a number from 0 to 1."""
    v = lambda bad, sev, why: F.when(bad, F.struct(F.lit(sev).alias("severity"), F.lit(why).alias("reason")))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    n = nodes.select("id", F.lit("node").alias("kind"), F.explode(F.array_compact(F.array(v(blank("id"), "ERROR", "no id"), v(blank("node_type"), "ERROR", "no type"), v(blank("label"), "WARNING", "no label")))).alias("v"))
    c = F.col("confidence")
    e = edges.select("id", F.lit("edge").alias("kind"), F.explode(F.array_compact(F.array(v(blank("source_id") | blank("target_id"), "ERROR", "no end"), v(blank("edge_type"), "ERROR", "no type"), v(c.isNotNull() & (F.isnan(c) | (c < 0) | (c > 1)), "ERROR", "confidence out of range")))).alias("v"))
    return n.unionByName(e).select("id", "kind", "v.severity", "v.reason")


def shapes_from_ontology(classes: DataFrame, properties: DataFrame, relations: DataFrame) -> DataFrame:
    """(class, path, kind, value): a target per class, a datatype per datatype property, a
    class per range, maxCount 1 per functional property."""
    t = classes.select("class", F.lit(None).cast("string").alias("path"), F.lit("targetClass").alias("kind"), F.col("class").alias("value"))
    d = properties.select("class", "path", F.lit("datatype").alias("kind"), F.col("datatype").alias("value"))
    r = relations.select(F.col("domain").alias("class"), "path", F.lit("class").alias("kind"), F.col("range").alias("value"))
    m = relations.where("functional").select(F.col("domain").alias("class"), "path", F.lit("maxCount").alias("kind"), F.lit("1").alias("value"))
    return t.unionByName(d).unionByName(r).unionByName(m)


def validate_shapes(nodes: DataFrame, edges: DataFrame, shapes: DataFrame, values: DataFrame) -> DataFrame:
    """(id, path, kind) of violations of datatype, class and maxCount shapes."""
    typed = nodes.select("id", F.col("node_type").alias("class"))
    dt = shapes.where("kind = 'datatype'").select("class", "path", "value")
    v = values.select("id", F.col("key").alias("path"), F.col("value").alias("v")).join(typed, "id").join(F.broadcast(dt.withColumnRenamed("value", "dt")), ["class", "path"])
    ok = F.when(F.col("dt") == "integer", F.col("v").try_cast("bigint").isNotNull()).when(F.col("dt") == "float", F.col("v").try_cast("double").isNotNull()).when(F.col("dt") == "boolean", F.lower("v").isin("true", "false", "0", "1")).otherwise(F.lit(True))
    bad1 = v.where(~ok & F.col("v").isNotNull()).select("id", "path", F.lit("datatype").alias("kind"))
    e = edges.select(F.col("source_id").alias("id"), F.col("edge_type").alias("path"), "target_id").join(typed, "id")
    cl = shapes.where("kind = 'class'").select("class", "path", F.col("value").alias("want"))
    ends = e.join(F.broadcast(cl), ["class", "path"]).join(nodes.select(F.col("id").alias("target_id"), F.col("node_type").alias("got")), "target_id", "left")
    bad2 = ends.where("got is null or got <> want").select("id", "path", F.lit("class").alias("kind"))
    mc = shapes.where("kind = 'maxCount'").select("class", "path", F.col("value").cast("int").alias("most"))
    bad3 = e.join(F.broadcast(mc), ["class", "path"]).groupBy("id", "path").agg(F.count(F.lit(1)).alias("n"), F.first("most").alias("most")).where("n > most").select("id", "path", F.lit("maxCount").alias("kind"))
    return bad1.unionByName(bad2).unionByName(bad3)


def pass_rate(n_violations, n_nodes, n_edges):
    total = n_nodes + n_edges
    return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - n_violations / total)))


def quality_score(consistency, acceptance, coverage, n_violations, valid):
    """Weighted sum; the shape part falls to 0 at 200 violations and is halved for an invalid graph."""
    shacl = (1 - F.least(n_violations, F.lit(MOST_VIOLATIONS)) / MOST_VIOLATIONS) * F.when(valid, 1.0).otherwise(0.5)
    return WEIGHTS["consistency"] * consistency + WEIGHTS["acceptance"] * acceptance + WEIGHTS["coverage"] * coverage + WEIGHTS["shacl"] * shacl


def action_set(entities: DataFrame, relations: DataFrame, inverses: dict[str, str]) -> DataFrame:
    """(action, target): a type or predicate to add once each, predicates with their inverse."""
    a = entities.select(F.lit("add_class").alias("action"), F.col("entity_type").alias("target")).distinct()
    p = relations.select("predicate").distinct()
    out = a.unionByName(p.select(F.lit("add_property").alias("action"), F.col("predicate").alias("target")))
    if inverses:
        m = F.create_map(*[F.lit(x) for kv in inverses.items() for x in kv])
        out = out.unionByName(p.select(F.lit("add_property").alias("action"), m[F.col("predicate")].alias("target")).where("target is not null"))
    return out.distinct()


def skos_confidence(mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """(mapping, concept, score): best of 1.0 for the preferred label, .7 for one label inside
    the other, .85 for an alternative label (tried only where there is no inclusion); of
    equals the smaller concept.

    Inclusion can't be a join key: each distinct label is looked up in an automaton of the
    concept labels and in their concatenation. The list must be a curated one: more than
    MOST_CONCEPTS concepts are refused. Null and blank labels map to nothing."""
    if concepts.count() > MOST_CONCEPTS:
        raise ValueError(f"more than {MOST_CONCEPTS} concepts")
    rows = [(r[0], (r[1] or "").lower(), [a.lower() for a in r[2] or [] if a]) for r in concepts.select("concept", "label", "alts").collect()]
    shared = mappings.sparkSession.sparkContext.broadcast(rows)
    kind = concepts.schema["concept"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        auto, exact, alts, text, starts = ahocorasick.Automaton(), {}, {}, [], []
        at = 0
        for c, label, more in shared.value:
            if label:
                exact.setdefault(label, []).append(c)
            for m in more:
                alts.setdefault(m, []).append(c)
            text.append(label)
            starts.append(at)
            at += len(label) + 1
        for label, cs in exact.items():
            auto.add_word(label, cs)
        if exact:
            auto.make_automaton()
        joined = "\x00".join(text)

        def best(name: str):
            if name in exact:
                return min(exact[name]), 1.0
            hit = {c for _, cs in auto.iter(name) for c in cs} if exact else set()
            i = joined.find(name)
            while i >= 0:
                k = bisect_right(starts, i) - 1
                hit.add(shared.value[k][0])
                i = joined.find(name, starts[k + 1]) if k + 1 < len(starts) else -1
            found = [(-0.7, c) for c in hit] + [(-0.85, c) for c in alts.get(name, []) if c not in hit]
            return (min(found)[1], -min(found)[0]) if found else None

        for x in batches:
            got = [(name, *b) for name in x["l"] if (b := best(name))]
            yield pd.DataFrame(got, columns=["l", "concept", "score"])

    m = mappings.select("mapping", F.lower(F.trim("label")).alias("l")).where("l <> ''").distinct()
    scored = m.select("l").distinct().mapInPandas(run, f"l string, concept {kind}, score double")
    return m.join(scored, "l").select("mapping", "concept", "score")
