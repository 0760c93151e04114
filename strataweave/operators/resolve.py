"""Deduplication, merging and synthesis of extracted entities."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import norm, positional_similarity


def keep_best(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order (ties need an order of their own).

    One aggregation with partial sums, not a window over whole groups: the least
    order-and-row struct of each key."""
    cols = df.columns
    k = [F.col(x) if isinstance(x, str) else x for x in keys]
    keyed = df.select(*(c.alias(f"__k{i}") for i, c in enumerate(k)), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*cols).alias("row")).alias("__s"))
    return keyed.groupBy(*(f"__k{i}" for i in range(len(k)))).agg(F.min("__s").alias("s")).select("s.row.*")


def dedup_entities(df: DataFrame) -> DataFrame:
    """Key: label without case and outer blanks, raw type; the strictly higher confidence wins, the first of equals."""
    return keep_best(df, [norm("label"), F.col("entity_type")], [-F.col("confidence"), F.col("ord")])


def assembly_dedup(df: DataFrame) -> DataFrame:
    """As ``dedup_entities``, but outer blanks of the label count."""
    return keep_best(df, [F.lower("label"), F.col("entity_type")], [-F.col("confidence"), F.col("ord")])


def ensemble_merge(df: DataFrame) -> DataFrame:
    """Best entity per (label, type) with confidence avg + min(.25, .1 (n-1)), at most .99, if n > 1."""
    g = df.groupBy(norm("label").alias("label_key"), "entity_type").agg(F.avg("confidence").alias("m"), F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("confidence")).alias("c"), "ord", "id", "label", "confidence")).alias("b"))
    conf = F.when(F.col("n") > 1, F.least(F.lit(0.99), F.col("m") + F.least(F.lit(0.25), 0.1 * (F.col("n") - 1)))).otherwise(F.col("b.confidence"))
    return g.select("b.id", "b.label", "entity_type", F.round(conf, 6).alias("confidence"), "n")


def merge_groups(df: DataFrame, group: str, bonus: float, most_bonus: float, cap: float, longest_label: bool = False) -> DataFrame:
    """One row per group: best entity (first of equals), confidence avg + bonus per further
    member up to ``most_bonus``, capped; merged_count."""
    g = df.groupBy(group).agg(F.avg("confidence").alias("m"), F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("confidence")).alias("c"), "ord", "id", "label")).alias("b"), F.min(F.struct((-F.length("label")).alias("l"), "ord", "label")).alias("x"))
    conf = F.least(F.lit(cap), F.col("m") + F.least(F.lit(most_bonus), bonus * (F.col("n") - 1)))
    return g.select(group, "b.id", (F.col("x.label") if longest_label else F.col("b.label")).alias("label"), F.round(conf, 6).alias("confidence"), F.col("n").alias("merged_count"))


def relation_consolidation(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations by subject, predicate, object; entity confidences raised by .02 per relation, at most 1)."""
    known = relations.join(entities.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    g = known.groupBy("source_id", "predicate", "target_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    raised = entities.join(g.groupBy(F.col("source_id").alias("id")).agg(F.sum("n").alias("k")), "id", "left")
    return g, raised.select("id", F.round(F.least(F.lit(1.0), F.col("confidence") + 0.02 * F.coalesce("k", F.lit(0))), 6).alias("confidence"))


def description_conflicts(df: DataFrame, key: str, description: str) -> DataFrame:
    """Ids with more than one distinct non-empty description."""
    return df.where(F.length(description) > 0).groupBy(key).agg(F.count_distinct(description).alias("n_descriptions")).where("n_descriptions > 1")


def domain_range_filter(relations: DataFrame, types: DataFrame, ontology: DataFrame) -> DataFrame:
    """Relations whose end types meet the domain and range of their predicate; unknown predicates pass."""
    t = lambda s: types.select(F.col("id").alias(f"{s}_id"), F.split("entity_type", r"[|]").alias(f"{s}_t"))
    j = relations.join(t("source"), "source_id", "left").join(t("target"), "target_id", "left").join(ontology, "predicate", "left")
    fits = lambda types_, allowed: F.col(allowed).isNull() | (F.size(allowed) == 0) | F.coalesce(F.arrays_overlap(types_, allowed), F.lit(False))
    return j.where(fits("source_t", "domain") & fits("target_t", "range")).select(*relations.columns)


def cardinality_filter(relations: DataFrame, ontology: DataFrame) -> DataFrame:
    """Functional predicates keep the best relation per source, inverse-functional ones per
    target (functional has priority); the first of equals wins."""
    j = relations.join(ontology.select("predicate", "functional", "inverse_functional"), "predicate", "left").fillna(False, ["functional", "inverse_functional"])
    end = F.when(F.col("functional"), F.col("source_id")).when(F.col("inverse_functional"), F.col("target_id")).otherwise(F.col("ord").cast("string"))
    return keep_best(j, [F.col("predicate"), end], [-F.col("confidence"), F.col("ord")]).select(*relations.columns)


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def greedy_clusters(df: DataFrame, similar: Callable[[str, str], bool], schema_key: str = "entity_type") -> DataFrame:
    """(key, ord, id, seed): seeds in order take every later unclustered label that is similar.

    The order decides, so it runs per type over the distinct labels only; equal labels go
    along with their first. The bound of the lengths prunes without loss for ratios of .75
    and more."""
    labels = df.groupBy(schema_key, "label").agg(F.min("ord").alias("ord"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ord")
        text, seeds, out = p["label"].tolist(), [], []
        for t in text:
            hit = next((s for s in seeds if similar(s, t)), None)
            if hit is None:
                seeds.append(t)
            out.append(hit if hit is not None else t)
        return pd.DataFrame({schema_key: p[schema_key], "label": text, "seed": out})

    t = df.schema[schema_key].dataType.simpleString()
    c = labels.groupBy(schema_key).applyInPandas(run, f"`{schema_key}` {t}, label string, seed string")
    return df.join(c, [schema_key, "label"])


def synthesis_similar(a: str, b: str) -> bool:
    """.7 ratio of lower-case labels + .3 for the equal type reaches .90."""
    a, b = a.lower(), b.lower()
    return 2 * min(len(a), len(b)) >= 6 / 7 * (len(a) + len(b)) and 0.7 * ratio(a, b) + 0.3 >= 0.9


def coreference_similar(a: str, b: str) -> bool:
    return 2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b)) and ratio(a, b) >= 0.85


def node_similarity(label_a, label_b, same_type, props_a=None, props_b=None):
    """.3 for the type, .4 times the positional likeness of labels, .3 times the overlap of property names."""
    from strataweave.functions.text import jaccard

    over = F.lit(1.0) if props_a is None else jaccard(props_a, props_b)
    return F.round(F.when(same_type, 0.3).otherwise(0.0) + 0.4 * positional_similarity(label_a, label_b) + 0.3 * over, 4)


def duplicate_pairs(nodes: DataFrame, threshold: float = 0.85, width: int = 3) -> DataFrame:
    """Pairs of one type with a node similarity of at least ``threshold``.

    With equal property names the labels must agree in a share of their places, so all but
    a few of a label's blocks of ``width`` places are shared: a prefix filter over the
    blocks, the rarest first, joins every such pair and few others."""
    need = (threshold - 0.6) / 0.4
    n = F.length("label")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width) - 1, F.lit(0)).cast("int")), lambda i: F.concat_ws("|", "node_type", i.cast("string"), F.substr("label", i * width + 1, F.lit(width))))
    x = nodes.select("id", "node_type", "label", F.explode(blocks).alias("b"))
    rare = x.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    keep = (F.floor(F.length("label") * ((1 - need) / need) + 1e-9) + 1).cast("int")
    per = x.join(rare, "b").groupBy("id", "node_type", "label").agg(F.array_sort(F.collect_list(F.struct("c", "b"))).alias("bs"))  # the blocks of one label
    pre = per.select("id", "label", F.explode(F.slice("bs", F.lit(1), keep)).alias("p")).select("id", "label", "p.b")
    one, two = (pre.select(F.col("id").alias(f"id_{s}"), F.col("label").alias(f"label_{s}"), "b") for s in "ab")
    p = one.join(two, "b").where("id_a < id_b").drop("b").distinct()
    return p.withColumn("similarity", node_similarity(F.col("label_a"), F.col("label_b"), F.lit(True))).where(F.col("similarity") >= threshold).select("id_a", "id_b", "similarity")


def provenance(findings: DataFrame, key: str, doc: str) -> DataFrame:
    return findings.select(norm(key).alias("key"), doc).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))


