"""Evaluation, experiment, discovery, review and linking queries."""

from pyspark.sql import functions as F

from strataweave.functions.text import positional_similarity
from strataweave.operators import experiments as X
from strataweave.operators import linking as L
from strataweave.queries.registry import query


@query("Q1_entity_query", "SELECT id FROM $k_nodes WHERE contains(label, 'turbine') OR contains(label, 'hall') ORDER BY id LIMIT 10")
def q1(t):
    return L.entity_query(t.k_nodes, "turbine hall")


@query("Q2_relation_query", "SELECT id FROM $k_edges WHERE len(list_filter(string_split(lower(edge_type), '_'), lambda p: contains('which component has a permit for the site', p))) > 0 ORDER BY id LIMIT 10")
def q2(t):
    return L.relation_query(t.k_edges, "which component has a permit for the site")


@query("Q3_count_query", "SELECT count(*) AS n FROM $g_nodes WHERE node_type = 'Customer'")
def q3(t):
    return t.g_nodes.where("node_type = 'Customer'").agg(F.count(F.lit(1)).alias("n"))


@query("Q4_boolean_query", "SELECT EXISTS (SELECT 1 FROM $g_edges WHERE source_id = 'C7' AND edge_type = 'located_in') AS answer")
def q4(t):
    return t.g_edges.where("source_id = 'C7' and edge_type = 'located_in'").agg((F.count(F.lit(1)) > 0).alias("answer"))


@query("Q5_complex_query", "SELECT n.label, count(*) AS n FROM $g_edges e JOIN $g_nodes n ON n.id = e.target_id WHERE e.edge_type = 'located_in' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q5(t):
    return t._spark.sql("SELECT n.label, count(*) AS n FROM {e} e JOIN {n} n ON n.id = e.target_id WHERE e.edge_type = 'located_in' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", e=t.g_edges, n=t.g_nodes)


_POS = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1 ELSE len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] = {b}[i])) / greatest(length({a}), length({b})) END"


@query("Q6_string_similarity", f"SELECT question_id, round({_POS.format(a='answer', b='expected')}, 6) AS s FROM $qa WHERE answer IS NOT NULL")
def q6(t):
    return t.qa.where("answer is not null").select("question_id", F.round(positional_similarity(F.col("answer"), F.col("expected")), 6).alias("s"))


@query("Q7_qa_metrics", f"WITH x AS (SELECT query_type, difficulty, CASE WHEN answer IS NOT NULL AND {_POS.format(a='answer', b='expected')} >= 0.8 THEN 1 ELSE 0 END AS ok, CASE WHEN answer IS NULL THEN 0 ELSE 1 END AS an FROM $qa) SELECT query_type, difficulty, count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(an), 6) AS coverage FROM x GROUP BY GROUPING SETS ((), (query_type), (difficulty))")
def q7(t):
    return X.qa_metrics(t.qa)


_PRF = "SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM z"


@query("Q9_entity_prf", f"WITH g AS (SELECT DISTINCT doc_id, start_char, end_char, label FROM $gold_spans), z AS (SELECT (SELECT count(*) FROM $pred_spans p WHERE (doc_id, start_char, end_char, label) IN (SELECT doc_id, start_char, end_char, label FROM g)) AS tp, (SELECT count(*) FROM $pred_spans p WHERE (doc_id, start_char, end_char, label) NOT IN (SELECT doc_id, start_char, end_char, label FROM g)) AS fp, (SELECT count(*) FROM g WHERE (doc_id, start_char, end_char, label) NOT IN (SELECT doc_id, start_char, end_char, label FROM $pred_spans)) AS fn) {_PRF}")
def q9(t):
    return X.entity_prf(t.gold_spans, t.pred_spans)


@query("Q10_relation_prf", f"WITH g AS (SELECT DISTINCT source_id, predicate, target_id FROM $relations WHERE ord % 2 = 0), p AS (SELECT DISTINCT source_id, predicate, target_id FROM $relations WHERE ord % 3 = 0), z AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p) q) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g) q) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p) q) AS fn) {_PRF}")
def q10(t):
    c = ["source_id", "predicate", "target_id"]
    return X.relation_prf(t.relations.where("ord % 2 = 0").select(*c), t.relations.where("ord % 3 = 0").select(*c))


@query("Q11_qa_split", "SELECT question_id, row_number() OVER (ORDER BY question_id) <= floor((SELECT count(*) FROM $qa WHERE difficulty BETWEEN 2 AND 4) * 0.7::DOUBLE) AS train FROM $qa WHERE difficulty BETWEEN 2 AND 4")
def q11(t):
    return L.prefix_split(t.qa.where("difficulty between 2 and 4"), "question_id", 0.7)


@query("Q12_gold_run", "SELECT entity_key, instr(d.text, g.text) - 1 AS start_char FROM (SELECT DISTINCT entity_key, doc_id, text FROM gold_entities) g JOIN (SELECT DISTINCT doc_id, text FROM gold_documents) d USING (doc_id) WHERE instr(d.text, g.text) > 0")
def q12(t):
    g = t.gold_entities.select("entity_key", "doc_id", F.col("text").alias("span")).distinct()
    return g.join(t.gold_documents.select("doc_id", "text").distinct(), "doc_id").withColumn("at", F.instr(F.col("text"), F.col("span"))).where("at > 0").select("entity_key", (F.col("at") - 1).alias("start_char"))


@query("X1_convergence", "WITH l AS (SELECT *, lag(value) OVER (PARTITION BY variant ORDER BY run_number) AS prev FROM $runs) SELECT variant, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(arg_max(value, run_number) - arg_min(value, run_number), 6) AS improvement, coalesce(abs(arg_max(value, run_number) - arg_max(prev, run_number)) < 0.01 * abs(arg_max(prev, run_number)), false) AS plateau FROM l GROUP BY variant")
def x1(t):
    return X.convergence(t.runs)


@query("X2_variant_comparison", "WITH m AS (SELECT variant, avg(value) AS mean FROM $runs GROUP BY 1) SELECT variant, row_number() OVER (ORDER BY m.mean DESC, variant) AS rank, round(m.mean, 6) AS mean, round(m.mean - lead(m.mean) OVER (ORDER BY m.mean DESC, variant), 6) AS margin FROM m")
def x2(t):
    return X.variant_comparison(t.runs)


@query("X3_run_statistics", "SELECT count(*) AS n_runs, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status <> 'completed') AS n_failed, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, round(avg(CASE WHEN status = 'completed' THEN 1 ELSE 0 END), 6) AS success_rate FROM $runs")
def x3(t):
    return X.run_statistics(t.runs)


@query("X4_metric_averages", "SELECT variant, round(avg(value), 4) AS value, round(avg(n), 4) AS n FROM $runs GROUP BY variant")
def x4(t):
    return t.runs.groupBy("variant").agg(F.round(F.avg("value"), 4).alias("value"), F.round(F.avg("n"), 4).alias("n"))


@query("X5_forward_fill", "WITH r AS (SELECT * FROM $runs WHERE (run_number + length(variant)) % 3 <> 0 OR run_number = 1), s AS (SELECT * FROM (SELECT DISTINCT variant FROM r) a, (SELECT DISTINCT run_number FROM r) b), f AS (SELECT s.run_number, last_value(r.value IGNORE NULLS) OVER (PARTITION BY s.variant ORDER BY s.run_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM s LEFT JOIN r USING (variant, run_number)) SELECT run_number, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM f GROUP BY 1")
def x5(t):
    return X.forward_filled(t.runs.where("(run_number + length(variant)) % 3 <> 0 or run_number = 1"))


@query("X6_snapshot_comparison", "SELECT coalesce(a.segment, b.segment) AS segment, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change, round(100.0::DOUBLE * (coalesce(b.n, 0) - coalesce(a.n, 0)) / a.n, 4) AS percent, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'lost' ELSE 'kept' END AS status FROM (SELECT segment, count(*) AS n FROM $snap_a GROUP BY 1) a FULL JOIN (SELECT segment, count(*) AS n FROM $snap_b GROUP BY 1) b ON a.segment = b.segment")
def x6(t):
    return X.distribution_change(t.snap_a, t.snap_b, "segment")


@query("I2_coverage", "SELECT count(*) AS k, 30::BIGINT AS n, round(count(*) / 30, 6) AS coverage FROM (SELECT DISTINCT node_type FROM nodes WHERE node_type IN (SELECT class_name FROM onto_classes)) q")
def i2(t):
    return X.coverage(t.nodes, t.onto_classes.withColumnRenamed("class_name", "node_type"), "node_type")


@query("I3_gap_questions", "SELECT class_name AS node_type, 'Which instances of ' || class_name || ' are mentioned in the documents?' AS question FROM onto_classes LEFT JOIN (SELECT node_type, count(*) AS n FROM nodes GROUP BY 1) q ON q.node_type = class_name WHERE coalesce(n, 0) < 200")
def i3(t):
    return X.questions_for_gaps(t.nodes, t.onto_classes.withColumnRenamed("class_name", "node_type"), "node_type", 200)


@query("I4_priority", "SELECT o_orderkey, round(0.5::DOUBLE * (1 - o_orderkey % 11 / 10) + 0.3::DOUBLE * (o_custkey % 2) + 0.2::DOUBLE * (o_orderkey % 3 / 2), 6) AS priority FROM orders")
def i4(t):
    o = t.orders
    return o.select("o_orderkey", F.round(X.priority(F.col("o_orderkey") % 11, F.col("o_custkey") % 2, (F.col("o_orderkey") % 3) / 2), 6).alias("priority"))


@query("I5_follow_ups", "SELECT DISTINCT node_type FROM nodes WHERE node_type IS NOT NULL AND node_type NOT IN (SELECT class_name FROM onto_classes) ORDER BY node_type LIMIT 5")
def i5(t):
    return t.nodes.where("node_type is not null").select("node_type").distinct().join(t.onto_classes.select(F.col("class_name").alias("node_type")), "node_type", "left_anti").orderBy("node_type").limit(5)


@query("I6_stopping", "SELECT variant, run_number, (value >= 50 AND n >= 9) OR run_number >= 25 AS stop, CASE WHEN value >= 50 AND n >= 9 THEN 'all met' WHEN run_number >= 25 THEN 'max iterations' WHEN value < 50 THEN 'questions' ELSE 'validation' END AS reason FROM $runs")
def i6(t):
    one = F.lit(1.0)
    stop, reason = X.stopping(F.col("value"), F.col("n"), one, one, F.col("run_number"), 25, (50, 9, 0.5, 1))
    return t.runs.select("variant", "run_number", stop.alias("stop"), reason.alias("reason"))


@query("N2_type_scores", "WITH t AS (SELECT DISTINCT lower(node_type) AS type FROM nodes WHERE length(node_type) > 0), c AS (SELECT lower(class_name) AS class FROM onto_classes) SELECT type, class, CASE WHEN type = class THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM t, c WHERE type = class OR contains(type, class) OR contains(class, type)")
def n2(t):
    return X.type_constraint_scores(t.nodes, [r[0] for r in t.onto_classes.select("class_name").collect()], "node_type")


@query("H1_unknown_types", "SELECT lower(trim(node_type)) AS type, count(*) AS n, count(*) >= 3 AS suggested FROM nodes WHERE length(trim(node_type)) > 0 AND lower(trim(node_type)) NOT IN (SELECT lower(class_name) FROM onto_classes) GROUP BY 1")
def h1(t):
    return X.unknown_types(t.nodes, t.onto_classes.withColumnRenamed("class_name", "node_type"), "node_type")


@query("H2_low_confidence", "SELECT mapping_id FROM (SELECT DISTINCT mapping_id, confidence FROM skos_mappings) q WHERE confidence < 0.5")
def h2(t):
    return t.skos_mappings.select("mapping_id", "confidence").distinct().where("confidence < 0.5").select("mapping_id")


@query("H3_consensus", "WITH p AS (SELECT item_id, decision, count(*) AS c, min(ts) AS f FROM $votes GROUP BY 1, 2), n AS (SELECT item_id, count(DISTINCT reviewer) AS n FROM $votes GROUP BY 1) SELECT item_id, arg_min(decision, (-c, f, decision)) AS decision, max(n) AS n FROM p JOIN n USING (item_id) WHERE n >= 3 GROUP BY item_id")
def h3(t):
    return X.consensus(t.votes)


@query("H4_feedback_summary", "SELECT decision, count(*) AS n FROM $votes GROUP BY decision")
def h4(t):
    return t.votes.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


_FB = "SELECT item_id, CASE WHEN decision IN ('view', 'click') THEN 'accepted' WHEN decision = 'signup' THEN 'modified' ELSE 'rejected' END AS decision, CASE WHEN reviewer % 3 = 0 THEN 'tbox_new_class' WHEN reviewer % 3 = 1 THEN 'abox_fix' ELSE 'cq' END AS feedback_type FROM $votes"


@query("H5_feedback_routing", f"SELECT item_id, CASE WHEN feedback_type LIKE 'tbox%' THEN 'TBox' WHEN feedback_type LIKE 'abox%' THEN 'ABox' ELSE 'CQ' END AS target FROM ({_FB}) q WHERE decision IN ('accepted', 'modified')")
def h5(t):
    v = t.votes
    d = F.when(F.col("decision").isin("view", "click"), "accepted").when(F.col("decision") == "signup", "modified").otherwise("rejected")
    k = F.when(F.col("reviewer") % 3 == 0, "tbox_new_class").when(F.col("reviewer") % 3 == 1, "abox_fix").otherwise("cq")
    return X.route_feedback(v.select("item_id", d.alias("decision"), k.alias("feedback_type")))


@query("H6_session_routing", f"SELECT CASE WHEN feedback_type LIKE 'tbox%' THEN 'TBox' WHEN feedback_type LIKE 'abox%' THEN 'ABox' ELSE 'CQ' END AS target, count(*) AS n FROM ({_FB}) q WHERE decision <> 'rejected' GROUP BY 1")
def h6(t):
    return h5(t).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("L1_explicit_citations")
def l1(t):
    return L.explicit_citations(t.doc_words, "doc_id", "text")


_RULES = "(VALUES (1, 'strahlenschutz|dosi', 'StrlSchG', NULL, 0.8::DOUBLE), (2, 'abfall|waste', 'AtG', '9a', 0.75::DOUBLE), (3, 'genehmigung|licence|permit', 'AtG', '7', 0.7::DOUBLE)) r(rule_no, pattern, law, section, confidence)"


@query("L2_keyword_links", f"SELECT DISTINCT entity_id, law, section, confidence FROM (SELECT DISTINCT entity_id, entity_label FROM skos_mappings WHERE entity_id IS NOT NULL AND entity_label IS NOT NULL) m JOIN (SELECT * FROM {_RULES}) r ON regexp_matches(lower(entity_label), pattern)")
def l2(t):
    m = t.skos_mappings.where("entity_id is not null").select("entity_id", F.col("entity_label").alias("label")).distinct()
    return L.keyword_links(m, L.EXAMPLE_RULES, "entity_id", "label")


@query("L3_type_defaults", f"WITH m AS (SELECT DISTINCT id, node_type FROM nodes WHERE node_type IN ('Facility', 'Permit')), k AS (SELECT DISTINCT entity_id FROM (SELECT DISTINCT entity_id, entity_label FROM skos_mappings) s JOIN (SELECT * FROM {_RULES}) r ON regexp_matches(lower(entity_label), pattern)) SELECT id, 'AtG' AS law, '7' AS section, 0.5::DOUBLE AS confidence FROM m WHERE id NOT IN (SELECT entity_id FROM k WHERE entity_id IS NOT NULL)")
def l3(t):
    m = t.skos_mappings.where("entity_id is not null").select("entity_id", F.col("entity_label").alias("label")).distinct()
    linked = L.keyword_links(m, L.EXAMPLE_RULES, "entity_id", "label").select(F.col("entity_id").alias("id")).distinct()
    d = t._spark.createDataFrame([("Facility", "AtG", "7", 0.5), ("Permit", "AtG", "7", 0.5)], "node_type string, law string, section string, confidence double")
    return L.type_defaults(t.nodes.select("id", "node_type").distinct(), linked, d)


@query("L4_relationship_type", "SELECT id, CASE WHEN node_type IN ('Facility', 'Organization', 'Process', 'Activity', 'Permit', 'SafetySystem', 'Regulation', 'Operation', 'Action', 'DomainRequirement', 'DomainPredicate', 'PlanningDomain', 'State') THEN 'GOVERNED_BY' WHEN contains(lower(label), 'defin') AND (contains(lower(label), 'definition') OR contains(lower(label), 'defined')) THEN 'DEFINED_IN' WHEN contains(lower(label), 'permit') OR contains(lower(label), 'approval') THEN 'REQUIRES' ELSE 'GOVERNED_BY' END AS rel FROM (SELECT DISTINCT id, node_type, coalesce(label, '') AS label FROM nodes WHERE node_type IS NOT NULL) q")
def l4(t):
    n = t.nodes.where("node_type is not null").select("id", "node_type", F.coalesce("label", F.lit("")).alias("label")).distinct()
    return n.select("id", L.relationship_type(F.col("node_type"), F.col("label")).alias("rel"))


@query("L6_paragraph_resolution", "WITH p AS (SELECT DISTINCT 'AtG_S_' || (o_orderkey % 50) AS pid FROM orders WHERE o_orderkey % 50 < 30), l AS (SELECT o_orderkey AS id, 'AtG' AS law, CAST(o_orderkey % 50 AS VARCHAR) AS section FROM orders) SELECT id, coalesce(pid, law) AS target FROM l LEFT JOIN p ON pid = law || '_S_' || section")
def l6(t):
    p = t.orders.where("o_orderkey % 50 < 30").select(F.concat(F.lit("AtG_S_"), (F.col("o_orderkey") % 50).cast("string")).alias("pid")).distinct()
    links = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("AtG").alias("law"), (F.col("o_orderkey") % 50).cast("string").alias("section"))
    return L.resolve_paragraphs(links, p).select("id", "target")


@query("L7_link_statistics", "SELECT edge_type, count(*) AS n FROM $k_edges WHERE source_id NOT IN (SELECT id FROM $k_nodes WHERE node_type = 'paragraph') GROUP BY ROLLUP (edge_type)")
def l7(t):
    law = t.k_nodes.where("node_type = 'paragraph'").select(F.col("id").alias("source_id"))
    return t.k_edges.join(law, "source_id", "left_anti").rollup("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("K11_version_diff", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM $snap_a a FULL JOIN $snap_b b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.balance <> b.balance OR a.segment <> b.segment")
def k11(t):
    from strataweave.operators.snapshots import snapshot_changes

    both = t.snap_a.withColumn("v", F.lit("a")).unionByName(t.snap_b.withColumn("v", F.lit("b"))).withColumn("at", F.lit(0))
    v = t._spark.createDataFrame([("a", 1), ("b", 2)], "v string, o int")
    return snapshot_changes(both, v, "id", "v", "o", "at", ("balance", "segment")).select("id", F.col("change_kind").alias("change"))


@query("K13_service_diff", "SELECT greatest(0, (SELECT count(*) FROM $snap_b) - (SELECT count(*) FROM $snap_a)) AS more, greatest(0, (SELECT count(*) FROM $snap_a) - (SELECT count(*) FROM $snap_b)) AS fewer")
def k13(t):
    a, b = t.snap_a.agg(F.count(F.lit(1)).alias("a")), t.snap_b.agg(F.count(F.lit(1)).alias("b"))
    return a.crossJoin(b).select(F.greatest(F.lit(0), F.col("b") - F.col("a")).alias("more"), F.greatest(F.lit(0), F.col("a") - F.col("b")).alias("fewer"))


@query("K10_version_list", "SELECT version_id, triggered_by FROM version_metadata ORDER BY created_at DESC")
def k10(t):
    return t.version_metadata.orderBy(F.col("created_at").desc(), "version_id").select("version_id", "triggered_by")


@query("K15_content_hash", "SELECT version_id, sha256('[' || string_agg('\"' || id || '\"', ', ' ORDER BY id) || ']') AS content_hash FROM (SELECT DISTINCT version_id, entity_id AS id FROM kg_snapshots WHERE entity_id IS NOT NULL) q GROUP BY version_id")
def k15(t):
    from strataweave.sources.export import content_hash

    return content_hash(t.kg_snapshots.where("entity_id is not null"), "version_id", "entity_id")


@query("K17_qa_rows", "SELECT question_id, expected || '|' || coalesce(answer, '') AS answers FROM $qa")
def k17(t):
    return t.qa.select("question_id", F.concat_ws("|", "expected", F.coalesce("answer", F.lit(""))).alias("answers"))


@query("R3_law_summary", "SELECT law, count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (kind = 'section') AS sections, sum(refs)::BIGINT AS refs FROM (SELECT source AS law, CASE WHEN contains(text, '## ') THEN 'section' ELSE 'paragraph' END AS kind, length(text) - length(replace(text, '§', '')) AS refs FROM (SELECT DISTINCT doc_id, source, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) q) z GROUP BY law")
def r3(t):
    d = t.documents.where("text is not null and source is not null").select("doc_id", "source", "text").distinct()
    kind = F.contains("text", F.lit("## "))
    return d.groupBy(F.col("source").alias("law")).agg(F.count(F.when(~kind, 1)).alias("paragraphs"), F.count(F.when(kind, 1)).alias("sections"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("§"), F.lit("")))).alias("refs"))


@query("R4_law_filter", "SELECT doc_id FROM (SELECT DISTINCT doc_id, source FROM documents) q WHERE source IN ('glossar', 'anhoerungen')")
def r4(t):
    return t.documents.select("doc_id", "source").distinct().where(F.col("source").isin("glossar", "anhoerungen")).select("doc_id")


@query("S9_law_sections", "WITH p AS (SELECT source_id AS law, ord AS pos, CASE WHEN ord % 5 = 0 THEN edge_type END AS heading FROM $k_edges), f AS (SELECT law, pos, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY law ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'General') AS section FROM p) SELECT law, section, count(*) AS n, min(pos) AS first FROM f GROUP BY 1, 2")
def s9(t):
    p = t.k_edges.select(F.col("source_id").alias("law"), F.col("ord").alias("pos"), F.when(F.col("ord") % 5 == 0, F.col("edge_type")).alias("heading"))
    return L.carried_headings(p).groupBy("law", "section").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


@query("S12_law_references", "SELECT source_id, 'referenziert' AS edge_type, coalesce(CASE WHEN target_id < source_id THEN target_id END, source_id) AS target, 0.9::DOUBLE AS confidence FROM $k_edges")
def s12(t):
    e = t.k_edges.withColumn("law", F.when(F.col("target_id") < F.col("source_id"), F.col("target_id")))
    return e.select("source_id", F.lit("referenziert").alias("edge_type"), F.coalesce("law", "source_id").alias("target"), F.lit(0.9).alias("confidence"))


@query("S22_subgraph_load", "SELECT id FROM $k_edges WHERE source_id IN (SELECT id FROM $k_nodes WHERE node_type IN ('component', 'permit')) AND target_id IN (SELECT id FROM $k_nodes WHERE node_type IN ('component', 'permit'))")
def s22(t):
    from strataweave.operators.graph import with_known_ends

    return with_known_ends(t.k_edges, t.k_nodes.where("node_type in ('component', 'permit')")).select("id")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    from strataweave.streaming.events import windowed_counts

    return windowed_counts(t.events, "1 hour")
