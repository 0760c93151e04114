"""Extraction merging and entity resolution queries."""

from pyspark.sql import functions as F

from strataweave.functions.text import entity_id, relation_id
from strataweave.operators import resolve as R
from strataweave.queries.registry import query

_ONTO = "SELECT * FROM (VALUES ('AF', true, false), ('NO', false, true), ('RF', false, false)) o(predicate, functional, inverse_functional)"


def _onto(t):
    return t._spark.createDataFrame([("AF", True, False), ("NO", False, True), ("RF", False, False)], "predicate string, functional boolean, inverse_functional boolean")


@query("E25_entity_ids", "SELECT o_orderkey AS k, 'ent_' || sha256(lower(trim(o_orderpriority)) || '::' || lower(trim(o_orderstatus)))[1:12] AS entity_id, 'supplied_by_' || sha256('S' || o_custkey || '::' || 'P' || o_orderkey || '::supplied by::' || '1')[1:12] AS relation_id FROM orders")
def e25(t):
    s, p = F.concat(F.lit("S"), F.col("o_custkey").cast("string")), F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("k"), entity_id("o_orderpriority", "o_orderstatus").alias("entity_id"), relation_id(s, p, F.lit("supplied by"), F.lit(1)).alias("relation_id"))


@query("E4_tiered", "WITH c AS (SELECT entity_type, count(*) AS n FROM $entities WHERE ord % 2 = 0 GROUP BY entity_type) SELECT e.id, CASE WHEN c.n >= 8 THEN 'rules' ELSE 'model' END AS tier FROM $entities e LEFT JOIN c USING (entity_type) WHERE (c.n >= 8 AND ord % 2 = 0) OR (coalesce(c.n, 0) < 8 AND ord % 2 = 1)")
def e4(t):
    e = t.entities
    rules, model = e.where("ord % 2 = 0"), e.where("ord % 2 = 1")
    enough = rules.groupBy("entity_type").count().where("count >= 8")
    a = rules.join(enough, "entity_type", "left_semi").select("id", F.lit("rules").alias("tier"))
    return a.unionByName(model.join(enough, "entity_type", "left_anti").select("id", F.lit("model").alias("tier")))


@query("E5_ensemble_merge", "SELECT arg_min(id, (-confidence, ord)) AS id, arg_min(label, (-confidence, ord)) AS label, entity_type, round(CASE WHEN count(*) > 1 THEN least(0.99::DOUBLE, avg(confidence) + least(0.25::DOUBLE, 0.1::DOUBLE * (count(*) - 1))) ELSE max(confidence) END, 6) AS confidence, count(*) AS n FROM $entities GROUP BY lower(trim(label)), entity_type")
def e5(t):
    return R.ensemble_merge(t.entities)


@query("E7_span_location", "SELECT ord, CASE WHEN instr(label, w) > 0 THEN instr(label, w) - 1 WHEN instr(lower(label), lower(w)) > 0 THEN instr(lower(label), lower(w)) - 1 WHEN length(split_part(w, ' ', 1)) > 3 AND instr(lower(label), lower(split_part(w, ' ', 1))) > 0 THEN instr(lower(label), lower(split_part(w, ' ', 1))) - 1 ELSE -1 END AS start_char FROM (SELECT ord, label, CASE WHEN ord % 3 = 0 THEN upper(label[3:8]) WHEN ord % 3 = 1 THEN label[2:6] ELSE split_part(label, ' ', 2) || ' zz' END AS w FROM $entities) q")
def e7(t):
    from strataweave.operators.extraction import locate_span

    w = F.when(F.col("ord") % 3 == 0, F.upper(F.substring("label", 3, 6))).when(F.col("ord") % 3 == 1, F.substring("label", 2, 5)).otherwise(F.concat(F.split_part("label", F.lit(" "), F.lit(2)), F.lit(" zz")))
    return t.entities.withColumn("w", w).select("ord", locate_span(F.col("label"), F.col("w")).alias("start_char"))


_BEST = "SELECT id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY {k}, entity_type ORDER BY confidence DESC, ord) AS r FROM $entities) q WHERE r = 1"


@query("E8_entity_dedup", _BEST.format(k="lower(trim(label))"))
def e8(t):
    return R.dedup_entities(t.entities).select("id", "confidence")


@query("D12_assembly_dedup", _BEST.format(k="lower(label)"))
def d12(t):
    return R.assembly_dedup(t.entities).select("id", "confidence")


@query("E10_domain_range", "SELECT r.ord FROM $k_edges r LEFT JOIN $k_nodes s ON s.id = r.source_id LEFT JOIN $k_nodes o ON o.id = r.target_id WHERE r.edge_type NOT IN ('requires', 'partOf') OR (s.node_type IN ('component', 'facility', 'activity') AND o.node_type IN ('component', 'permit', 'facility'))")
def e10(t):
    o = t._spark.createDataFrame([("requires", ["component", "facility", "activity"], ["component", "permit", "facility"]), ("partOf", ["component", "facility", "activity"], ["component", "permit", "facility"])], "predicate string, domain array<string>, range array<string>")
    types = t.k_nodes.select("id", F.col("node_type").alias("entity_type"))
    return R.domain_range_filter(t.k_edges.withColumnRenamed("edge_type", "predicate"), types, o).select("ord")


@query("E11_cardinality", f"WITH o AS ({_ONTO}), j AS (SELECT r.*, CASE WHEN o.functional THEN source_id WHEN o.inverse_functional THEN target_id ELSE CAST(ord AS STRING) END AS e FROM $relations r LEFT JOIN o USING (predicate)) SELECT ord, confidence FROM (SELECT *, row_number() OVER (PARTITION BY predicate, e ORDER BY confidence DESC, ord) AS k FROM j) q WHERE k = 1")
def e11(t):
    return R.cardinality_filter(t.relations, _onto(t)).select("ord", "confidence")


_MERGE = "SELECT {k} AS grp, arg_min(id, (-confidence, ord)) AS id, {l} AS label, round(least({cap}::DOUBLE, avg(confidence) + least({most}::DOUBLE, {b}::DOUBLE * (count(*) - 1))), 6) AS confidence, count(*) AS merged_count FROM $entities GROUP BY 1"


@query("D2_group_merge", _MERGE.format(k="label", l="arg_min(label, (-confidence, ord))", cap=1, most=0.1, b=0.05))
def d2(t):
    return R.merge_groups(t.entities.withColumn("grp", F.col("label")), "grp", 0.05, 0.1, 1.0)


@query("D7_coreference_merge", _MERGE.format(k="entity_type", l="arg_min(label, (-length(label), ord))", cap=0.99, most=0.05, b=1))
def d7(t):
    return R.merge_groups(t.entities.withColumn("grp", F.col("entity_type")), "grp", 1.0, 0.05, 0.99, longest_label=True)


@query("D3_relation_consolidation", "SELECT source_id, predicate, target_id, count(*) AS n, round(avg(confidence), 6) AS confidence FROM $relations WHERE source_id IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) GROUP BY ALL")
def d3(t):
    ents = t.supplier.where("s_suppkey % 3 <> 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(0.5).alias("confidence"))
    return R.relation_consolidation(t.relations, ents)[0]


@query("D3_finding_confidence", "SELECT 'S' || s_suppkey AS id, round(least(1::DOUBLE, 0.5::DOUBLE + 0.02::DOUBLE * coalesce(k, 0)), 6) AS confidence FROM supplier LEFT JOIN (SELECT source_id, count(*) AS k FROM $relations WHERE predicate = 'RF' AND confidence > 0.98 GROUP BY 1) q ON source_id = 'S' || s_suppkey")
def d3b(t):
    ents = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(0.5).alias("confidence"))
    return R.relation_consolidation(t.relations.where("predicate = 'RF' and confidence > 0.98"), ents)[1]


@query("D4_description_conflicts", "SELECT entity_id, count(DISTINCT description) AS n_descriptions FROM enriched_entities WHERE length(description) > 0 GROUP BY entity_id HAVING count(DISTINCT description) > 1")
def d4(t):
    return R.description_conflicts(t.enriched_entities, "entity_id", "description")


@query("D1_synthesis_clusters")
def d1(t):
    e = t.entities
    return R.greedy_clusters(e, R.synthesis_similar).select("id", "seed")


@query("D5_dedup_map")
def d5(t):
    e = t.entities.withColumn("all", F.lit("x"))
    return R.greedy_clusters(e, R.synthesis_similar, "all").groupBy("seed").agg(F.count(F.lit(1)).alias("n_members"), F.min("id").alias("first_id"))


@query("D6_coreference")
def d6(t):
    c = R.greedy_clusters(t.entities, R.coreference_similar)
    return c.groupBy("entity_type", "seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("D10_duplicate_pairs", """
WITH x AS (SELECT id, node_type, label FROM $k_nodes),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.label AS la, b.label AS lb FROM x a JOIN x b ON a.node_type = b.node_type AND a.id < b.id)
SELECT id_a, id_b, round(0.3::DOUBLE + 0.4::DOUBLE * (len(list_filter(range(1, least(length(la), length(lb)) + 1), lambda i: la[i] = lb[i])) / greatest(length(la), length(lb))) + 0.3::DOUBLE, 4) AS similarity FROM p
WHERE round(0.6::DOUBLE + 0.4::DOUBLE * (len(list_filter(range(1, least(length(la), length(lb)) + 1), lambda i: la[i] = lb[i])) / greatest(length(la), length(lb))), 4) >= 0.95""")
def d10(t):
    return R.duplicate_pairs(t.k_nodes, 0.95)


@query("D14_provenance", "SELECT lower(trim(label)) AS key, count(DISTINCT doc_id) AS n_docs FROM gold_entities WHERE doc_id IS NOT NULL GROUP BY 1")
def d14(t):
    return R.provenance(t.gold_entities.where("doc_id is not null"), "label", "doc_id")
