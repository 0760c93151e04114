"""Queries that combine operators: model-backed steps, merging, loops, exports."""

from pyspark.sql import functions as F

from strataweave.operators import discovery as D
from strataweave.operators import merging as M
from strataweave.operators import providers as P
from strataweave.operators import retrieval as T
from strataweave.queries.registry import query
from strataweave.queries.texts import _BM25, _SPARSE, _TOK, Q
from strataweave.sources import export as K


@query("T9_rerank", f"WITH x AS (SELECT doc_id, score FROM ({_SPARSE}) s ORDER BY score DESC, doc_id LIMIT 20) SELECT doc_id, round(len(list_intersect(list_distinct({_TOK.format(x='lower(text)')}), list_distinct(string_split('{Q}', ' ')))) / len(list_distinct(string_split('{Q}', ' '))), 6) AS rerank_score FROM x JOIN $doc_words USING (doc_id)")
def t9(t):
    d = t.doc_words
    hits = T.best(T.sparse_scores(d, Q), 20).join(d, "doc_id")
    return P.rerank(hits, Q, "text", P.OverlapReranker()).select("doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query("T10_enhanced", f"WITH {_BM25} SELECT doc_id FROM b WHERE score > 0 ORDER BY b.score DESC, doc_id LIMIT 10")
def t10(t):
    d = t.doc_words
    hits = T.best(T.bm25_scores(d, Q), 10).join(d, "doc_id")
    return P.rerank(hits, Q, "text", P.OverlapReranker()).select("doc_id")


@query("T17_text_context")
def t17(t):
    d = P.with_embeddings(t.doc_words.select("doc_id", F.substring("text", 1, 2000).alias("head")), "head", P.HashEmbedder())
    q = P.HashEmbedder().embed([Q])[0].tolist()
    return T.dense_top_k(d, q, 5, "doc_id", "embedding").withColumn("score", F.round("score", 5))


@query("E6_model_entities")
def e6(t):
    return P.model_entities(t.doc_words, "doc_id", "text", P.CapitalisedModel())


@query("E16_legal_entity_merge")
def e16(t):
    from strataweave.operators.extraction import legal_entities

    rules = legal_entities(t.doc_words, "doc_id", "text").withColumn("confidence", F.lit(0.95))
    model = rules.where(F.length("label") % 2 == 0).withColumn("confidence", F.lit(0.8))
    return M.legal_entities(rules, model, "doc_id").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


_R = "SELECT source_id AS source, predicate, target_id AS target, max(confidence) AS c FROM $relations WHERE {w} GROUP BY 1, 2, 3"


@query("E17_legal_relation_merge", f"WITH r AS ({_R.format(w='ord % 2 = 0')}), m AS ({_R.format(w='ord % 3 = 0')}) SELECT source, predicate, target, round(CASE WHEN r.c IS NOT NULL AND m.c IS NOT NULL THEN least(1.0::DOUBLE, (0.7::DOUBLE * r.c + 0.5::DOUBLE * m.c) / 2 + 0.15::DOUBLE) WHEN r.c IS NOT NULL THEN 0.7::DOUBLE * r.c ELSE 0.5::DOUBLE * m.c END, 6) AS confidence FROM r FULL JOIN m USING (source, predicate, target) WHERE CASE WHEN r.c IS NOT NULL THEN 1.0 ELSE 0.5::DOUBLE * m.c END >= 0.4")
def e17(t):
    r = t.relations.select("ord", F.col("source_id").alias("source"), "predicate", F.col("target_id").alias("target"), "confidence")
    return M.legal_relations(r.where("ord % 2 = 0"), r.where("ord % 3 = 0")).withColumn("confidence", F.round("confidence", 6))


@query("D8_entity_resolver")
def d8(t):
    return M.resolve(t.enriched_entities, "record_id", "label", "semantic_embedding").withColumn("score", F.round("score", 5))


@query("D9_merge_candidates")
def d9(t):
    return M.merge_candidates(M.resolve(t.enriched_entities, "record_id", "label", "semantic_embedding"))


@query("D13_discovery_merge", "SELECT lower(trim(label)) AS label_key, lower(trim(entity_type)) AS type_key, arg_min(id, (-confidence, ord)) AS id, max(confidence) AS confidence, count(*) AS n FROM $entities GROUP BY 1, 2")
def d13(t):
    e = t.entities.withColumn("source_id", F.col("id"))
    best, _ = M.discovery_merge(e)
    first = e.groupBy(F.lower(F.trim("label")).alias("label_key"), F.lower(F.trim("entity_type")).alias("type_key")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "ord", "id")).alias("b"))
    return best.join(first, ["label_key", "type_key"]).select("label_key", "type_key", "b.id", "confidence", "n")


@query("D13_evidence", "SELECT lower(trim(label)) AS label_key, lower(trim(entity_type)) AS type_key, 'doc' || (ord % 7) AS source_id, min(ord) AS ord FROM $entities GROUP BY 1, 2, 3")
def d13b(t):
    return M.discovery_merge(t.entities.withColumn("source_id", F.concat(F.lit("doc"), (F.col("ord") % 7).cast("string"))))[1]


@query("I1_discovery_loop")
def i1(t):
    classes = t.onto_classes.select(F.lower("class_name").alias("entity_type"))
    kinds = t.k_nodes.select("id", F.col("node_type").alias("entity_type"))
    find = lambda i, left: kinds.where(F.pmod(F.xxhash64("id"), F.lit(5)) == i).join(left, "entity_type", "left_semi")
    found, seen = D.discover(find, classes)
    return found.groupBy("iteration").agg(F.count(F.lit(1)).alias("n"))


@query("S14_new_documents", "SELECT doc_id, sha256(text) AS hash FROM $doc_words WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def s14(t):
    done = t.documents.where("doc_id % 2 = 0 and text is not null").select(F.sha2("text", 256).alias("hash")).distinct()
    return D.process_new(t.doc_words, done, "text").select("doc_id", "hash")


@query("S15_pages", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id, text ORDER BY i) - 1 AS INT) AS page, md5(p) AS content FROM (SELECT doc_id, text, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\\n\\s*\\n'), 1) AS i FROM $doc_words) q WHERE trim(p, ' ') <> ''")
def s15(t):
    return D.pages(t.doc_words, "doc_id", "text").select("doc_id", "page", F.md5("content").alias("content"))


@query("N1_descriptions", "SELECT count(*) AS n, count(*) FILTER (description IS NULL OR trim(description) = '') AS filled FROM (SELECT DISTINCT record_id, label, description FROM enriched_entities) q")
def n1(t):
    e = t.enriched_entities.select("record_id", "label", "description").distinct()
    out = P.fill_missing(e, "description", "label", P.CapitalisedModel())
    return out.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("description").startswith("```json"), 1)).alias("filled"))


@query("N3_enrichment_counts", "SELECT count(*) AS n, count(description) AS with_description, count(semantic_embedding) AS with_semantic_embedding, count(source_type) AS with_source_type FROM enriched_entities")
def n3(t):
    return P.enrichment_counts(t.enriched_entities, ["description", "semantic_embedding", "source_type"])


_JS = "CASE WHEN {c} IS NOT NULL THEN '\"{n}\":' || to_json({c}) END"


@query("K1_json", f"""SELECT 'node' AS kind, '{{' || concat_ws(',', {", ".join(_JS.format(c=c, n=c) for c in ("id", "label", "node_type"))}) || '}}' AS json FROM $k_nodes
UNION ALL SELECT 'edge', '{{' || concat_ws(',', {", ".join(_JS.format(c=c, n=c) for c in ("id", "source_id", "target_id", "edge_type"))}) || '}}' FROM $k_edges""")
def k1(t):
    return K.to_json_lines(t.k_nodes, t.k_edges.select("id", "source_id", "target_id", "edge_type"))


@query("K2_jsonld")
def k2(t):
    return K.to_jsonld(t.k_nodes, t.k_edges)


_SAFE = "CASE WHEN regexp_matches(translate({c}, ' -/', '___'), '^[0-9]') THEN '_' || translate({c}, ' -/', '___') ELSE translate({c}, ' -/', '___') END"


@query("K3_turtle", f"SELECT ':' || id || ' a :' || {_SAFE.format(c='node_type')} || ' .' AS line FROM $k_nodes WHERE node_type IS NOT NULL UNION ALL SELECT ':' || id || ' rdfs:label \"' || replace(replace(replace(label, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n') || '\" .' FROM $k_nodes WHERE label IS NOT NULL UNION ALL SELECT ':' || source_id || ' :' || {_SAFE.format(c='edge_type')} || ' :' || target_id || ' .' FROM $k_edges")
def k3(t):
    return K.to_turtle(t.k_nodes, t.k_edges)


_QUO = "'\"' || replace(replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n') || '\"'"


@query("K4_cypher", f"""SELECT 1 AS no, 'CREATE (:' || {_SAFE.format(c='node_type')} || ' {{id: ' || {_QUO.format(c='id')} || ', label: ' || {_QUO.format(c="coalesce(label, '')")} || '}});' AS statement FROM $k_nodes
UNION ALL SELECT 2, 'CREATE INDEX FOR (n:' || t || ') ON (n.id);' FROM (SELECT DISTINCT {_SAFE.format(c='node_type')} AS t FROM $k_nodes) q
UNION ALL SELECT 3, 'MATCH (a {{id: ' || {_QUO.format(c='source_id')} || '}}), (b {{id: ' || {_QUO.format(c='target_id')} || '}}) CREATE (a)-[:' || {_SAFE.format(c='edge_type')} || ']->(b);' FROM $k_edges""")
def k4(t):
    return K.to_cypher(t.k_nodes, t.k_edges)


_ESC = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("K5_graphml", f"""SELECT 1 AS no, '<node id="' || {_ESC.format(c='id')} || '"><data key="label">' || {_ESC.format(c="substr(coalesce(label, ''), 1, 500)")} || '</data></node>' AS line FROM $k_nodes
UNION ALL SELECT 2, '<edge source="' || {_ESC.format(c='source_id')} || '" target="' || {_ESC.format(c='target_id')} || '"><data key="type">' || {_ESC.format(c='edge_type')} || '</data></edge>' FROM $k_edges""")
def k5(t):
    return K.to_graphml(t.k_nodes, t.k_edges)


@query("L5_link_cascade")
def l5(t):
    from strataweave.operators import linking as L

    n = t.nodes.where("label is not null").select("id", "label", "node_type").distinct()
    ex = L.explicit_citations(n, "id", "label").select("id", F.col("law_code").alias("law"), "section", "confidence")
    kw = L.keyword_links(n, L.EXAMPLE_RULES, "id", "label")
    d = t._spark.createDataFrame([("Facility", "AtG", "7", 0.5)], "node_type string, law string, section string, confidence double")
    return L.cascade(ex, kw, L.type_defaults(n, ex.select("id").distinct(), d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("R5_paragraph_fetch", "SELECT p.id, p.label, n.target_id AS section, r.target_id AS law FROM $g_nodes p LEFT JOIN $g_edges n ON n.source_id = p.id AND n.edge_type = 'located_in' LEFT JOIN $g_edges r ON r.source_id = n.target_id AND r.edge_type = 'part_of' WHERE p.node_type = 'Customer' AND r.target_id = 'R1'")
def r5(t):
    e = t.g_edges
    n = e.where("edge_type = 'located_in'").select(F.col("source_id").alias("id"), F.col("target_id").alias("section"))
    r = e.where("edge_type = 'part_of'").select(F.col("source_id").alias("section"), F.col("target_id").alias("law"))
    return t.g_nodes.where("node_type = 'Customer'").select("id", "label").join(n, "id", "left").join(r, "section", "left").where("law = 'R1'").select("id", "label", "section", "law")


@query("S10_law_entities", "SELECT DISTINCT source AS id, 'Law' AS kind, 1.0::DOUBLE AS confidence FROM documents WHERE source IS NOT NULL UNION ALL SELECT DISTINCT 'p' || doc_id, 'Paragraph', 1.0::DOUBLE FROM documents WHERE source IS NOT NULL")
def s10(t):
    d = t.documents.where("source is not null").select("doc_id", "source").distinct()
    one = F.lit(1.0).alias("confidence")
    return d.select(F.col("source").alias("id"), F.lit("Law").alias("kind"), one).distinct().unionByName(d.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"), F.lit("Paragraph").alias("kind"), one))


@query("S11_part_of", "SELECT DISTINCT 'p' || doc_id AS source_id, 'teilVon' AS edge_type, source AS target_id, 1.0::DOUBLE AS confidence FROM documents WHERE source IS NOT NULL")
def s11(t):
    d = t.documents.where("source is not null").select("doc_id", "source").distinct()
    return d.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("teilVon").alias("edge_type"), F.col("source").alias("target_id"), F.lit(1.0).alias("confidence"))


@query("M2_datatype_properties", "SELECT key AS property, CASE WHEN bool_and(try_cast(value AS BIGINT) IS NOT NULL) THEN 'integer' WHEN bool_and(try_cast(value AS DOUBLE) IS NOT NULL) THEN 'float' ELSE 'string' END AS datatype FROM (SELECT unnest(map_keys(props)) AS key, unnest(map_values(props)) AS value FROM kg_snapshots) q GROUP BY key")
def m2(t):
    v = t.kg_snapshots.select(F.explode("props").alias("property", "v"))
    return v.groupBy("property").agg(F.when(F.bool_and(F.col("v").try_cast("bigint").isNotNull()), "integer").when(F.bool_and(F.col("v").try_cast("double").isNotNull()), "float").otherwise("string").alias("datatype"))


@query("M6_special_properties", "WITH e AS (SELECT DISTINCT source_id AS a, target_id AS b, edge_type AS t FROM $g_edges) SELECT t AS property, max(n) = 1 AS functional FROM (SELECT t, a, count(*) AS n FROM e GROUP BY 1, 2) q GROUP BY t")
def m6(t):
    e = t.g_edges.select("source_id", "target_id", "edge_type").distinct()
    return e.groupBy("edge_type", "source_id").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("edge_type").alias("property")).agg((F.max("n") == 1).alias("functional"))


@query("E4b_tiered_relations", "WITH c AS (SELECT predicate, count(*) AS n FROM $relations WHERE ord % 2 = 0 GROUP BY 1) SELECT r.ord, CASE WHEN c.n >= 100 THEN 'rules' ELSE 'model' END AS tier FROM $relations r LEFT JOIN c USING (predicate) WHERE (c.n >= 100 AND ord % 2 = 0) OR (coalesce(c.n, 0) < 100 AND ord % 2 = 1)")
def e4b(t):
    r = t.relations.select("ord", "predicate")
    rules, model = r.where("ord % 2 = 0"), r.where("ord % 2 = 1")
    enough = rules.groupBy("predicate").count().where("count >= 100")
    return rules.join(enough, "predicate", "left_semi").select("ord", F.lit("rules").alias("tier")).unionByName(model.join(enough, "predicate", "left_anti").select("ord", F.lit("model").alias("tier")))


@query("V6_rules_from_ontology", "SELECT 'functional' AS rule, edge_type AS property FROM (SELECT edge_type, source_id, count(DISTINCT target_id) AS n FROM $g_edges GROUP BY 1, 2) q GROUP BY edge_type HAVING max(n) = 1")
def v6(t):
    per = t.g_edges.groupBy("edge_type", "source_id").agg(F.count_distinct("target_id").alias("n"))
    return per.groupBy(F.col("edge_type").alias("property")).agg(F.max("n").alias("m")).where("m = 1").select(F.lit("functional").alias("rule"), "property")


@query("A25_analytics_pipeline", """
WITH e AS (SELECT DISTINCT source_id, target_id, edge_type FROM $g_edges), i AS (SELECT target_id AS s, source_id AS t FROM e WHERE edge_type = 'supplies')
SELECT 'before' AS stage, count(*) AS n_edges FROM e UNION ALL SELECT 'after', (SELECT count(*) FROM e) + (SELECT count(*) FROM i)""")
def a25(t):
    from strataweave.operators.inference import full_inference

    e = t.g_edges.select("source_id", "target_id", "edge_type").distinct()
    new = full_inference(e, ["near"], [("supplies", "suppliedBy")], [])
    one = lambda d, s: d.agg(F.lit(s).alias("stage"), F.count(F.lit(1)).alias("n_edges"))
    return one(e, "before").unionByName(one(e.unionByName(new), "after"))


@query("B7_embedding_suite")
def b7(t):
    from strataweave.operators import embeddings as B
    from strataweave.operators import structural as A

    c = B.kmeans(t.embeddings, "vec_id", "embedding", 10)
    j = t.embeddings.select("vec_id", "label", "embedding").join(c, "vec_id")
    return A.pair_counts(j, "label", "cluster").crossJoin(A.mutual_information(j, "label", "cluster")).crossJoin(B.coherence(j, "cluster", "embedding", 64).agg(F.round(F.avg("coherence"), 5).alias("coherence")))


@query("R6_resolution_pass")
def r6(t):
    from strataweave.operators.structural import components

    p = M.resolve(t.enriched_relations, "record_id", "predicate", "semantic_embedding")
    return components(p.select(F.col("a").cast("string").alias("source_id"), F.col("b").cast("string").alias("target_id")))


@query("R7_triples_of_node", "SELECT 'rdf:type' AS p, node_type AS o FROM $g_nodes WHERE id = 'S3' UNION ALL SELECT 'rdfs:label', label FROM $g_nodes WHERE id = 'S3' UNION ALL SELECT ':' || edge_type, target_id FROM $g_edges WHERE source_id = 'S3'")
def r7(t):
    from strataweave.operators.graph import to_triples

    return to_triples(t.g_nodes, t.g_edges).where("s = 'S3'").select("p", "o")


@query("R8_nodes_by_type", "SELECT id AS s FROM $g_nodes WHERE node_type = 'Nation'")
def r8(t):
    from strataweave.operators.graph import to_triples

    return to_triples(t.g_nodes, t.g_edges).where("p = 'rdf:type' and o = 'Nation'").select("s")


@query("R9_quality_phrases", "SELECT variant AS setting, CASE WHEN avg(value) > 60 THEN 'strong' WHEN avg(value) > 40 THEN 'moderate' ELSE 'weak' END AS phrase FROM $runs GROUP BY 1")
def r9(t):
    from strataweave.operators.experiments import setting_profile

    p = setting_profile(t.runs, None).where("metric = 'mean'")
    return p.select("setting", F.when(F.col("value") > 60, "strong").when(F.col("value") > 40, "moderate").otherwise("weak").alias("phrase"))


@query("R19_rate_limit", "SELECT count(*) AS over_limit FROM (SELECT count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) q WHERE n > 1")
def r19(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-60_000_000, 0)
    return t.events.withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1").agg(F.count(F.lit(1)).alias("over_limit"))


@query("R20_validation_report", """SELECT 'shape' AS kind, id, 'no label' AS reason FROM $k_nodes WHERE label IS NULL OR trim(label, ' ') = ''
UNION ALL SELECT 'shape', id, 'no type' FROM $k_nodes WHERE node_type IS NULL OR trim(node_type, ' ') = ''
UNION ALL SELECT 'shape', id, 'confidence out of range' FROM $k_edges WHERE confidence IS NOT NULL AND (isnan(confidence) OR confidence < 0 OR confidence > 1)
UNION ALL SELECT 'functional', source_id, 'supplies' FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS r FROM $g_edges WHERE edge_type = 'supplies') q WHERE r > 1""")
def r20(t):
    from strataweave.operators import validation as V

    shape = V.shape_violations(t.k_nodes, t.k_edges).select(F.lit("shape").alias("kind"), "id", "reason")
    return shape.unionByName(V.functional_violations(t.g_edges, "supplies").select(F.lit("functional").alias("kind"), F.col("source_id").alias("id"), F.lit("supplies").alias("reason")))


@query("G15_batched_build", "SELECT 'node' AS kind, id, node_type AS type FROM $g_nodes UNION ALL SELECT 'edge', id, edge_type FROM $g_edges")
def g15(t):
    from strataweave.operators.graph import with_known_ends
    from strataweave.plans.lineage import materialize

    n = materialize(t.g_nodes, "nodes")
    e = materialize(with_known_ends(t.g_edges, n), "edges")
    return n.select(F.lit("node").alias("kind"), "id", F.col("node_type").alias("type")).unionByName(e.select(F.lit("edge").alias("kind"), "id", F.col("edge_type").alias("type")))


@query("K18_action_json", """SELECT '{"action":"' || a || '","target":"' || x || '"}' AS json FROM (SELECT DISTINCT 'add_class' AS a, entity_type AS x FROM $entities UNION ALL SELECT DISTINCT 'add_property', predicate FROM $relations) q""")
def k18(t):
    from strataweave.operators.validation import action_set

    return action_set(t.entities, t.relations, {}).select(F.to_json(F.struct("action", "target")).alias("json"))


@query("K20_findings_yaml", """WITH r AS (SELECT source_id, edge_type, string_agg(DISTINCT target_id, ', ' ORDER BY target_id) AS o FROM $k_edges GROUP BY 1, 2), p AS (SELECT source_id, string_agg('      ' || edge_type || ': [' || o || ']', chr(10) ORDER BY edge_type) AS t FROM r GROUP BY 1),
n AS (SELECT entity_id AS id, count(DISTINCT record_id) AS c, max(description) AS d FROM enriched_entities WHERE entity_id IS NOT NULL GROUP BY 1)
SELECT k.id, concat_ws(chr(10), '  - id: ' || k.id, '    label: ' || label, '    type: ' || node_type, '    confidence: 0.80', CASE WHEN t IS NOT NULL THEN '    relations:' || chr(10) || t END, CASE WHEN c > 0 THEN '    evidence_count: ' || c END, CASE WHEN d IS NOT NULL THEN '    first_evidence: "' || translate(substr(d, 1, 100), chr(10), ' ') || '..."' END) AS yaml
FROM $k_nodes k LEFT JOIN p ON p.source_id = k.id LEFT JOIN n USING (id)""")
def k20(t):
    per = t.k_edges.groupBy(F.col("source_id").alias("id"), "edge_type").agg(F.array_sort(F.collect_set("target_id")).alias("o"))
    rel = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("edge_type", "o"))).alias("relations"))
    ev = t.enriched_entities.where("entity_id is not null").groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("record_id").alias("n_evidence"), F.max("description").alias("first_evidence"))
    return K.findings_yaml(t.k_nodes.withColumnRenamed("node_type", "entity_type").withColumn("confidence", F.lit(0.8)).join(rel, "id", "left").join(ev, "id", "left"))


@query("K19_vector_upsert", "SELECT count(*) AS n, count(*) FILTER (vec_id >= 100000) AS added FROM (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 100000 FROM embeddings WHERE vec_id % 5 = 0) q")
def k19(t):
    from strataweave.operators.graph import upsert

    v = t.embeddings.select("vec_id", "embedding")
    kept = v.join(v.where("vec_id % 7 = 0").select("vec_id"), "vec_id", "left_anti")
    new = v.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 100000)
    return upsert(kept, new, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") >= 100000, 1)).alias("added"))
