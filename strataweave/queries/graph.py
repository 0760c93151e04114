"""Graph algebra, inference and validation queries."""

from pyspark.sql import functions as F

from strataweave.operators import graph as G
from strataweave.operators import inference as I
from strataweave.operators import validation as V
from strataweave.queries.registry import query


@query("G1_node_by_id", "SELECT id, node_type, label FROM $g_nodes WHERE id = 'N7'")
def g1(t):
    return t.g_nodes.where("id = 'N7'").select("id", "node_type", "label")


@query("G2_nodes_by_type", "SELECT id, label FROM $g_nodes WHERE node_type = 'Supplier'")
def g2(t):
    return t.g_nodes.where("node_type = 'Supplier'").select("id", "label")


@query("G3_upsert", "SELECT id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 3 = 0 AND node_type = 'Customer' THEN upper(label) || '!' ELSE label END AS label FROM $g_nodes UNION ALL SELECT 'X1', 'new'")
def g3(t):
    n = t.g_nodes.select("id", "label")
    new = t.g_nodes.where("node_type = 'Customer' and cast(substr(id, 2) as bigint) % 3 = 0").select("id", F.concat(F.upper("label"), F.lit("!")).alias("label"))
    return G.upsert(n, new.unionByName(t._spark.createDataFrame([("X1", "new")], "id string, label string")))


@query("G3_last_write", "SELECT entity_id AS id, max(loaded_at) AS loaded_at FROM kg_snapshots WHERE entity_id IS NOT NULL GROUP BY 1")
def g3b(t):
    return G.last_write(t.kg_snapshots.where("entity_id is not null").select(F.col("entity_id").alias("id"), "loaded_at", "label"), "id", "loaded_at").select("id", "loaded_at")


@query("G4_known_ends", "SELECT e.id FROM $k_edges e WHERE source_id IN (SELECT id FROM $k_nodes WHERE node_type <> 'component') AND target_id IN (SELECT id FROM $k_nodes WHERE node_type <> 'component')")
def g4(t):
    return G.with_known_ends(t.k_edges, t.k_nodes.where("node_type <> 'component'")).select("id")


@query("G5_update_properties", "SELECT id, props['page'] AS page, 'reviewed' AS status, cardinality(props) - CASE WHEN len(map_extract(props, 'status')) > 0 THEN 1 ELSE 0 END + 1 AS n FROM (SELECT DISTINCT id, props FROM nodes) q WHERE props IS NOT NULL")
def g5(t):
    n = t.nodes.where("props is not null").groupBy("id", F.array_sort(F.map_entries("props")).alias("e")).count().withColumn("props", F.map_from_entries("e"))
    m = n.withColumn("props", G.merge_properties(F.col("props"), F.create_map(F.lit("status"), F.lit("reviewed"))))
    return m.select("id", F.col("props")["page"].alias("page"), F.col("props")["status"].alias("status"), F.size("props").cast("long").alias("n"))


@query("G6_delete_cascade", "SELECT id FROM $g_edges WHERE source_id NOT IN (SELECT id FROM $g_nodes WHERE node_type = 'Supplier') AND target_id NOT IN (SELECT id FROM $g_nodes WHERE node_type = 'Supplier')")
def g6(t):
    return G.delete_nodes(t.g_nodes, t.g_edges, t.g_nodes.where("node_type = 'Supplier'"))[1].select("id")


@query("G7_edges_of", "SELECT id FROM $g_edges WHERE source_id = 'N3' OR target_id = 'N3'")
def g7(t):
    return G.edges_of(t.g_edges, "N3", "both").select("id")


@query("G8_store_query", "SELECT node_type, count(*) AS n FROM $g_nodes GROUP BY node_type")
def g8(t):
    return t._spark.sql("SELECT node_type, count(*) AS n FROM {nodes} GROUP BY node_type", nodes=t.g_nodes)


@query("G9_statistics", "SELECT n_nodes, n_types, lo, mean, hi, n_edges, n_edge_types, round(n_edges / (n_nodes * (n_nodes - 1)), 9) AS density FROM (SELECT count(*) AS n_nodes, count(DISTINCT node_type) AS n_types, min(confidence) AS lo, round(avg(confidence), 6) AS mean, max(confidence) AS hi FROM $g_nodes) a, (SELECT count(*) AS n_edges, count(DISTINCT edge_type) AS n_edge_types FROM $g_edges) b")
def g9(t):
    return G.statistics(t.g_nodes, t.g_edges)


@query("G10_type_counts", "SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM $g_nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM $g_edges GROUP BY 2")
def g10(t):
    return G.type_counts(t.g_nodes, t.g_edges)


@query("G11_k_hop", """
WITH RECURSIVE arcs AS (SELECT source_id AS a, target_id AS b FROM $k_edges UNION SELECT target_id, source_id FROM $k_edges),
seed AS (SELECT min(source_id) AS id FROM $k_edges), r(id, h) AS (SELECT id, 0 FROM seed UNION SELECT arcs.b, r.h + 1 FROM r JOIN arcs ON arcs.a = r.id WHERE r.h < 3) SELECT id, min(h) AS hops FROM r GROUP BY id""")
def g11(t):
    return G.k_hop(t.k_edges, t.k_edges.agg(F.min("source_id").alias("id")), 3)


@query("G11_subgraph_edges", """
WITH RECURSIVE arcs AS (SELECT source_id AS a, target_id AS b FROM $k_edges UNION SELECT target_id, source_id FROM $k_edges),
seed AS (SELECT min(source_id) AS id FROM $k_edges), r(id, h) AS (SELECT id, 0 FROM seed UNION SELECT arcs.b, r.h + 1 FROM r JOIN arcs ON arcs.a = r.id WHERE r.h < 1) SELECT id FROM $k_edges WHERE source_id IN (SELECT id FROM r) OR target_id IN (SELECT id FROM r)""")
def g11b(t):
    return G.subgraph(t.k_nodes, t.k_edges, t.k_edges.agg(F.min("source_id").alias("id")), 2)[1].select("id")


@query("G12_triple_neighbourhood", "SELECT s, p, o FROM (SELECT id AS s, 'rdf:type' AS p, node_type AS o FROM $g_nodes UNION ALL SELECT id, 'rdfs:label', label FROM $g_nodes UNION ALL SELECT source_id, ':' || edge_type, target_id FROM $g_edges) q WHERE s = 'N3' OR o = 'N3'")
def g12(t):
    return G.to_triples(t.g_nodes, t.g_edges).where("s = 'N3' or o = 'N3'").select("s", "p", "o")


@query("G13_rdf_statistics", "SELECT (SELECT count(*) FROM $g_nodes) AS n_typed, (SELECT count(*) FROM (SELECT id FROM $g_nodes UNION SELECT source_id FROM $g_edges) q) AS n_with_others")
def g13(t):
    return G.rdf_statistics(G.to_triples(t.g_nodes, t.g_edges))


@query("G16_assemble", "SELECT e.id, coalesce(k.c, 0) AS evidence_count, coalesce(k.s, 0) AS n_sources FROM $entities e LEFT JOIN (SELECT entity_id, count(*) AS c, count(DISTINCT source_id) AS s FROM $evidence GROUP BY 1) k ON k.entity_id = e.id")
def g16(t):
    return G.assemble(t.entities, t.g_edges, t.evidence)[0].select("id", "evidence_count", "n_sources")


@query("G16_skipped_edges", "SELECT count(*) AS n_skipped FROM $k_edges WHERE source_id NOT IN (SELECT id FROM $k_nodes) OR target_id NOT IN (SELECT id FROM $k_nodes)")
def g16b(t):
    return G.assemble(t.k_nodes, t.k_edges, t.evidence)[2]


@query("G17_assembler_statistics", "SELECT round(avg(e.confidence), 6) AS mean_confidence, count(DISTINCT e.entity_type) AS n_types, sum(coalesce(k.c, 0))::BIGINT AS evidence_sum, round(avg(coalesce(k.c, 0)), 6) AS mean_evidence FROM $entities e LEFT JOIN (SELECT entity_id, count(*) AS c FROM $evidence GROUP BY 1) k ON k.entity_id = e.id")
def g17(t):
    n = G.assemble(t.entities, t.g_edges, t.evidence)[0]
    return n.agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_distinct("entity_type").alias("n_types"), F.sum("evidence_count").alias("evidence_sum"), F.round(F.avg("evidence_count"), 6).alias("mean_evidence"))


@query("G18_label_statistics", "SELECT count(*) AS n, count(DISTINCT label) AS n_labels, round(avg(confidence), 6) AS mean, max(confidence) AS hi FROM $entities")
def g18(t):
    return t.entities.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels"), F.round(F.avg("confidence"), 6).alias("mean"), F.max("confidence").alias("hi"))


@query("G19_triple_pattern", "SELECT c.source_id AS customer, n.target_id AS region FROM $g_edges c JOIN $g_edges n ON c.target_id = n.source_id WHERE c.edge_type = 'located_in' AND n.edge_type = 'part_of' AND c.source_id LIKE 'C%'")
def g19(t):
    x = G.to_triples(t.g_nodes, t.g_edges)
    a, b = x.where("p = ':located_in' and s like 'C%'").select(F.col("s").alias("customer"), F.col("o").alias("m")), x.where("p = ':part_of'").select(F.col("s").alias("m"), F.col("o").alias("region"))
    return a.join(b, "m").select("customer", "region")


@query("G20_ontology_valid", "SELECT count(*) = 0 AS valid FROM (SELECT DISTINCT edge_type FROM $k_edges) e WHERE edge_type NOT IN (SELECT DISTINCT edge_type FROM $k_edges JOIN $k_nodes ON id_ = source_id)".replace("id_ = source_id", "$k_nodes.id = source_id"))
def g20(t):
    with_domain = t.k_edges.join(t.k_nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("edge_type").distinct()
    return t.k_edges.select("edge_type").distinct().join(with_domain, "edge_type", "left_anti").agg((F.count(F.lit(1)) == 0).alias("valid"))


@query("M5_hierarchy_depth", "WITH RECURSIVE p AS (SELECT DISTINCT concept_id AS c, broader_id AS b FROM skos_concepts WHERE broader_id IS NOT NULL), r(x, d) AS (SELECT c, 0 FROM (SELECT concept_id AS c FROM skos_concepts WHERE broader_id IS NULL AND concept_id IN (SELECT b FROM p)) q UNION ALL SELECT p.c, r.d + 1 FROM r JOIN p ON p.b = r.x) SELECT x AS class, max(d) AS depth FROM r GROUP BY x")
def m5(t):
    return I.hierarchy_depth(t.skos_concepts.select(F.col("concept_id").alias("child"), F.col("broader_id").alias("parent")))


@query("M1_classes", "SELECT class_id, class_name AS label FROM onto_classes ORDER BY class_id LIMIT 100")
def m1(t):
    return t.onto_classes.select("class_id", F.coalesce("class_name", "class_id").alias("label")).orderBy("class_id").limit(100)


@query("M3_class_relations", "SELECT DISTINCT e.edge_type FROM $k_edges e JOIN $k_nodes n ON n.id IN (e.source_id, e.target_id) WHERE n.node_type = 'permit'")
def m3(t):
    ids = t.k_nodes.where("node_type = 'permit'").select("id")
    side = lambda c: t.k_edges.join(ids.withColumnRenamed("id", c), c, "left_semi").select("edge_type")
    return side("source_id").unionByName(side("target_id")).distinct()


@query("M4_all_relations", "SELECT DISTINCT edge_type FROM $k_edges ORDER BY 1 LIMIT 200")
def m4(t):
    return t.k_edges.select("edge_type").distinct().orderBy("edge_type").limit(200)


_BACK = "SELECT DISTINCT target_id AS source_id, source_id AS target_id, edge_type FROM $k_edges WHERE edge_type IN ({p}) EXCEPT SELECT source_id, target_id, edge_type FROM $k_edges"


@query("M7_symmetry", _BACK.format(p="SELECT min(edge_type) FROM $k_edges"))
def m7(t):
    p = t.k_edges.agg(F.min("edge_type")).first()[0]
    return I.missing_reverse(t.k_edges, [p])


@query("M8_inverse", """
WITH b AS (SELECT min(edge_type) AS p, max(edge_type) AS q FROM $k_edges), e AS (SELECT DISTINCT source_id, target_id, edge_type FROM $k_edges),
f AS (SELECT target_id AS source_id, source_id AS target_id, q AS edge_type FROM e, b WHERE edge_type = p EXCEPT SELECT * FROM e)
SELECT * FROM f UNION (SELECT x.target_id, x.source_id, b.p FROM (SELECT * FROM e UNION SELECT * FROM f) x, b WHERE x.edge_type = b.q EXCEPT SELECT * FROM e)""")
def m8(t):
    p, q = t.k_edges.agg(F.min("edge_type"), F.max("edge_type")).first()
    return I.materialise_inverse(t.k_edges, p, q)


_TRANS = "WITH e AS (SELECT DISTINCT source_id, target_id FROM $g_edges WHERE edge_type IN ('located_in', 'part_of')) SELECT a.source_id, b.target_id, 'in' AS edge_type FROM e a JOIN e b ON a.target_id = b.source_id WHERE a.source_id <> b.target_id EXCEPT SELECT source_id, target_id, 'in' FROM e"


@query("M9_transitivity", _TRANS)
def m9(t):
    e = t.g_edges.where("edge_type in ('located_in', 'part_of')").withColumn("edge_type", F.lit("in"))
    return I.materialise_transitive(e, "in")


@query("M9_closure", "WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM $k_edges WHERE edge_type = (SELECT min(edge_type) FROM $k_edges)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS source_id, b AS target_id, (SELECT min(edge_type) FROM $k_edges) AS edge_type FROM r WHERE a <> b EXCEPT SELECT a, b, (SELECT min(edge_type) FROM $k_edges) FROM e")
def m9b(t):
    p = t.k_edges.agg(F.min("edge_type")).first()[0]
    return I.materialise_transitive(t.k_edges, p, closure=True)


@query("M10_class_hierarchy", "SELECT id, 'Party' AS node_type FROM $g_nodes WHERE node_type IN ('Customer', 'Supplier') UNION ALL SELECT id, 'Thing' FROM $g_nodes WHERE node_type IN ('Customer', 'Supplier')")
def m10(t):
    return I.materialise_classes(t.g_nodes, [("Customer", "Party"), ("Supplier", "Party"), ("Party", "Thing")])


@query("M11_full_inference", """
WITH e AS (SELECT DISTINCT source_id, target_id, CASE WHEN edge_type = 'supplies' THEN edge_type ELSE 'in' END AS edge_type FROM $g_edges),
i AS (SELECT target_id, source_id, 'suppliedBy' FROM e WHERE edge_type = 'supplies'), t AS (SELECT a.source_id, b.target_id, 'in' FROM e a JOIN e b ON a.target_id = b.source_id AND a.edge_type = 'in' AND b.edge_type = 'in')
SELECT target_id AS source_id, source_id AS target_id, 'suppliedBy' AS edge_type FROM e WHERE edge_type = 'supplies' UNION SELECT * FROM (SELECT * FROM t EXCEPT SELECT * FROM e) q""")
def m11(t):
    e = t.g_edges.withColumn("edge_type", F.when(F.col("edge_type") == "supplies", "supplies").otherwise("in"))
    return I.full_inference(e, ["near"], [("supplies", "suppliedBy")], ["in"])


@query("V1_inverse_rule", "WITH b AS (SELECT min(edge_type) AS p, max(edge_type) AS q FROM $k_edges) SELECT source_id, edge_type, target_id FROM $k_edges e, b WHERE edge_type = p AND NOT EXISTS (SELECT 1 FROM $k_edges f WHERE f.edge_type = b.q AND f.source_id = e.target_id AND f.target_id = e.source_id)")
def v1(t):
    p, q = t.k_edges.agg(F.min("edge_type"), F.max("edge_type")).first()
    return V.inverse_violations(t.k_edges, p, q)


@query("V2_transitive_rule", "WITH e AS (SELECT * FROM $k_edges WHERE edge_type = (SELECT min(edge_type) FROM $k_edges)) SELECT a.source_id, a.edge_type, b.target_id FROM e a JOIN e b ON a.target_id = b.source_id WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.source_id = a.source_id AND c.target_id = b.target_id)")
def v2(t):
    return V.transitive_violations(t.k_edges, t.k_edges.agg(F.min("edge_type")).first()[0])


@query("V3_domain_range", "SELECT e.id, 'source_id' AS \"end\", n.node_type FROM $g_edges e JOIN $g_nodes n ON n.id = source_id WHERE edge_type = 'located_in' AND n.node_type NOT IN ('Supplier') UNION ALL SELECT e.id, 'target_id', n.node_type FROM $g_edges e JOIN $g_nodes n ON n.id = target_id WHERE edge_type = 'located_in' AND n.node_type NOT IN ('Nation')")
def v3(t):
    return V.domain_range_violations(t.g_edges, t.g_nodes, "located_in", ["Supplier"], ["Nation"])


_FUNC = "SELECT id, source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS r FROM $g_edges WHERE edge_type = '{p}') q WHERE r > 1"


@query("V4_functional_rule", _FUNC.format(p="supplies"))
def v4(t):
    return V.functional_violations(t.g_edges, "supplies")


@query("V5_rules_engine", f"SELECT 'functional' AS rule, count(*) AS n FROM ({_FUNC.format(p='supplies')}) a UNION ALL SELECT 'inverse', count(*) FROM $g_edges WHERE edge_type = 'part_of' UNION ALL SELECT 'range', count(*) FROM $g_edges e JOIN $g_nodes n ON n.id = e.target_id WHERE e.edge_type = 'located_in' AND n.node_type <> 'Region'")
def v5(t):
    one = lambda d, r: d.agg(F.lit(r).alias("rule"), F.count(F.lit(1)).alias("n"))
    return one(V.functional_violations(t.g_edges, "supplies"), "functional").unionByName(one(V.inverse_violations(t.g_edges, "part_of", "has_part"), "inverse")).unionByName(one(V.domain_range_violations(t.g_edges, t.g_nodes, "located_in", [], ["Region"]), "range"))


@query("V7_type_conflicts", "WITH ty AS (SELECT DISTINCT id, node_type FROM nodes WHERE node_type IS NOT NULL UNION SELECT DISTINCT id, 'Organization' FROM nodes WHERE hash_ IN (0)), p AS (SELECT * FROM (VALUES ('Person', 'Organization'), ('Organization', 'Person'), ('Person', 'Location'), ('Location', 'Person'), ('Organization', 'Location'), ('Location', 'Organization')) v(a, b)) SELECT x.id, p.a, p.b FROM ty x JOIN p ON p.a = x.node_type JOIN ty y ON y.id = x.id AND y.node_type = p.b".replace("hash_ IN (0)", "length(label) % 3 = 0"))
def v7(t):
    ty = t.nodes.select("id", "node_type").where("node_type is not null").unionByName(t.nodes.where("length(label) % 3 = 0").select("id", F.lit("Organization").alias("node_type")))
    return V.type_conflicts(ty)


_VALS = "SELECT DISTINCT id, unnest(map_keys(props)) AS key, unnest(map_values(props)) AS value FROM (SELECT entity_id AS id, props FROM kg_snapshots WHERE entity_id IS NOT NULL) q"


def _vals(t):
    return t.kg_snapshots.where("entity_id is not null").select(F.col("entity_id").alias("id"), F.explode("props").alias("key", "value")).distinct()


@query("V8_value_conflicts", f"SELECT id, key, count(DISTINCT value) AS n FROM ({_VALS}) v WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def v8(t):
    return V.value_conflicts(_vals(t))


@query("V9_cardinality_conflicts", f"SELECT id, key, count(*) AS n FROM ({_VALS}) v WHERE key = 'page' GROUP BY 1, 2 HAVING count(*) > 1")
def v9(t):
    return V.cardinality_conflicts(_vals(t), ("page",))


@query("V10_conflicts_of_one", "WITH v AS (SELECT DISTINCT id, node_type, unnest(map_keys(props)) AS key, unnest(map_values(props)) AS value FROM nodes WHERE node_type IS NOT NULL), m AS (SELECT * FROM v WHERE id = (SELECT min(id) FROM nodes WHERE node_type = 'Component' AND props IS NOT NULL)) SELECT v.id, v.key, v.value, m.value AS mine FROM v JOIN m USING (node_type, key) WHERE v.id <> m.id AND v.value <> m.value")
def v10(t):
    first = t.nodes.where("node_type = 'Component' and props is not null").agg(F.min("id")).first()[0]
    v = t.nodes.where("node_type is not null").select("id", "node_type", F.explode("props").alias("key", "value")).distinct()
    return V.conflicts_of(v, first)


@query("V11_consistency_report", f"SELECT 'value' AS kind, count(*) AS n FROM (SELECT id, key FROM ({_VALS}) v WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) > 1) q UNION ALL SELECT 'cardinality', count(*) FROM (SELECT id FROM ({_VALS}) v WHERE key = 'page' GROUP BY id HAVING count(*) > 1) q")
def v11(t):
    one = lambda d, k: d.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one(V.value_conflicts(_vals(t)), "value").unionByName(one(V.cardinality_conflicts(_vals(t), ("page",)), "cardinality"))


@query("V12_shape_check", """
WITH n AS (SELECT DISTINCT id, node_type, label FROM nodes)
SELECT id, 'node' AS kind, 'ERROR' AS severity, 'no type' AS reason FROM n WHERE node_type IS NULL OR trim(node_type) = ''
UNION ALL SELECT id, 'node', 'WARNING', 'no label' FROM n WHERE label IS NULL OR trim(label) = ''
UNION ALL SELECT id, 'edge', 'ERROR', 'confidence out of range' FROM $k_edges WHERE confidence IS NOT NULL AND (isnan(confidence) OR confidence < 0 OR confidence > 1)
UNION ALL SELECT id, 'edge', 'ERROR', 'no end' FROM $k_edges WHERE trim(source_id) = '' OR trim(target_id) = ''
UNION ALL SELECT id, 'edge', 'ERROR', 'no type' FROM $k_edges WHERE trim(edge_type) = ''""")
def v12(t):
    return V.shape_violations(t.nodes.select("id", "node_type", "label").distinct(), t.k_edges)


def _shapes(t):
    s = t._spark
    return V.shapes_from_ontology(t.onto_classes.select(F.lower("class_name").alias("class")), s.createDataFrame([("component", "page", "integer"), ("component", "unit", "integer")], "class string, path string, datatype string"), s.createDataFrame([("component", "requires", "permit", True)], "domain string, path string, range string, functional boolean"))


@query("V13_shapes", "SELECT lower(class_name) AS class, NULL AS path, 'targetClass' AS kind, lower(class_name) AS value FROM onto_classes UNION ALL SELECT * FROM (VALUES ('component', 'page', 'datatype', 'integer'), ('component', 'unit', 'datatype', 'integer'), ('component', 'requires', 'class', 'permit'), ('component', 'requires', 'maxCount', '1')) v")
def v13(t):
    return _shapes(t)


@query("V14_shape_validation", f"WITH s AS (SELECT entity_id AS id, min(lower(node_type)) AS node_type FROM kg_snapshots WHERE entity_id IS NOT NULL GROUP BY 1) SELECT v.id, v.key AS path, 'datatype' AS kind FROM ({_VALS}) v JOIN s USING (id) WHERE s.node_type = 'component' AND v.key IN ('page', 'unit') AND try_cast(v.value AS BIGINT) IS NULL")
def v14(t):
    n = t.kg_snapshots.where("entity_id is not null").groupBy(F.col("entity_id").alias("id")).agg(F.min(F.lower("node_type")).alias("node_type"))
    return V.validate_shapes(n, t.k_edges.where("false"), _shapes(t), _vals(t))


@query("V15_rdf", "SELECT id AS s, 'rdf:type' AS p, node_type AS o, false AS literal FROM $g_nodes WHERE node_type IS NOT NULL UNION ALL SELECT id, 'rdfs:label', label, true FROM $g_nodes WHERE label IS NOT NULL UNION ALL SELECT source_id, ':' || edge_type, target_id, false FROM $g_edges")
def v15(t):
    return G.to_triples(t.g_nodes, t.g_edges)


@query("V16_pass_rate", "SELECT round(1 - v / (n + e), 6) AS pass_rate FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT id, node_type, label FROM nodes) q WHERE node_type IS NULL) AS v, (SELECT count(DISTINCT id) FROM nodes) AS n, (SELECT count(*) FROM $k_edges) AS e) q")
def v16(t):
    v = t.nodes.select("id", "node_type", "label").distinct().where("node_type is null").agg(F.count(F.lit(1)).alias("v"))
    n, e = t.nodes.agg(F.count_distinct("id").alias("n")), t.k_edges.agg(F.count(F.lit(1)).alias("e"))
    return v.crossJoin(n).crossJoin(e).select(F.round(V.pass_rate(F.col("v"), F.col("n"), F.col("e")), 6).alias("pass_rate"))


@query("V17_quality_score", "SELECT round(0.3::DOUBLE * 0.9::DOUBLE + 0.2::DOUBLE * acc + 0.15::DOUBLE * cov + 0.35::DOUBLE * (1 - least(v, 200) / 200) * 0.5::DOUBLE, 6) AS score FROM (SELECT avg(CASE WHEN confidence >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc, count(DISTINCT node_type) / 30 AS cov FROM $k_edges e JOIN $k_nodes n ON n.id = e.source_id) a, (SELECT count(*) AS v FROM $k_edges WHERE confidence < 0 OR confidence > 1) b")
def v17(t):
    j = t.k_edges.join(t.k_nodes.select(F.col("id").alias("source_id"), "node_type"), "source_id")
    a = j.agg(F.avg(F.when(F.col("confidence") >= 0.5, 1.0).otherwise(0.0)).alias("acc"), (F.count_distinct("node_type") / 30).alias("cov"))
    b = t.k_edges.where("confidence < 0 or (confidence > 1 and not isnan(confidence)) or isnan(confidence)").agg(F.count(F.lit(1)).alias("v"))
    return a.crossJoin(b).select(F.round(V.quality_score(F.lit(0.9), F.col("acc"), F.col("cov"), F.col("v"), F.lit(False)), 6).alias("score"))


@query("V18_class_coverage", "SELECT round(least(1.0::DOUBLE, count(DISTINCT node_type) / (SELECT count(*) FROM onto_classes)), 6) AS coverage FROM nodes WHERE node_type IN (SELECT class_name FROM onto_classes)")
def v18(t):
    got = t.nodes.join(t.onto_classes.select(F.col("class_name").alias("node_type")), "node_type", "left_semi").agg(F.count_distinct("node_type").alias("k"))
    return got.crossJoin(t.onto_classes.agg(F.count(F.lit(1)).alias("n"))).select(F.round(F.least(F.lit(1.0), F.col("k") / F.col("n")), 6).alias("coverage"))


@query("V19_action_samples", "SELECT node_type, min(id) AS sample FROM $g_nodes GROUP BY node_type ORDER BY node_type LIMIT 500")
def v19(t):
    return t.g_nodes.groupBy("node_type").agg(F.min("id").alias("sample")).orderBy("node_type").limit(500)


@query("V20_action_set", "SELECT DISTINCT 'add_class' AS action, entity_type AS target FROM $entities UNION SELECT DISTINCT 'add_property', predicate FROM $relations UNION SELECT 'add_property', 'FO_inverse'")
def v20(t):
    return V.action_set(t.entities, t.relations, {"NO": "FO_inverse"})


@query("V22_skos_confidence", """
WITH m AS (SELECT DISTINCT mapping_id AS mapping, lower(trim(entity_label, ' ')) AS l FROM skos_mappings WHERE trim(entity_label, ' ') <> ''),
j AS (SELECT mapping, concept_id AS concept, CASE WHEN l = lower(pref_label) THEN 1.0::DOUBLE WHEN contains(lower(pref_label), l) OR contains(l, lower(pref_label)) THEN 0.7::DOUBLE WHEN list_contains(list_transform(alt_labels, lambda a: lower(a)), l) THEN 0.85::DOUBLE END AS score FROM m, skos_concepts)
SELECT mapping, arg_min(concept, (-score, concept)) AS concept, max(score) AS score FROM j WHERE score IS NOT NULL GROUP BY mapping""")
def v22(t):
    m = t.skos_mappings.select(F.col("mapping_id").alias("mapping"), F.col("entity_label").alias("label")).distinct()
    return V.skos_confidence(m, t.skos_concepts.select(F.col("concept_id").alias("concept"), F.col("pref_label").alias("label"), F.col("alt_labels").alias("alts")))


@query("R1_edge_ids", "SELECT ord, edge_type || '_' || sha256(edge_type || ':' || source_id || ':' || target_id || ':' || (row_number() OVER (PARTITION BY edge_type, source_id, target_id ORDER BY ord) - 1))[1:12] AS new_id FROM $k_edges")
def r1(t):
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("edge_type", "source_id", "target_id").orderBy("ord")) - 1
    return t.k_edges.withColumn("seq", seq.cast("string")).select("ord", F.concat("edge_type", F.lit("_"), F.substring(F.sha2(F.concat_ws(":", "edge_type", "source_id", "target_id", "seq"), 256), 1, 12)).alias("new_id"))
