"""Derived tables: a property graph, entities, relations, runs and votes."""

from strataweave.queries.registry import view

# A property graph over the star schema.
view("g_nodes", """
SELECT 'R' || CAST(r_regionkey AS STRING) AS id, 'Region' AS node_type, r_name AS label, CAST(NULL AS DOUBLE) AS confidence FROM $region
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'Nation', n_name, CAST(NULL AS DOUBLE) FROM $nation
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'Customer', c_name, round((c_acctbal + 1000) / 11000, 4) FROM $customer
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'Supplier', s_name, round((s_acctbal + 1000) / 11000, 4) FROM $supplier
UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 'Part', p_name, CAST(NULL AS DOUBLE) FROM $part""")
view("g_edges0", """
SELECT 'C' || CAST(c_custkey AS STRING) AS source_id, 'N' || CAST(c_nationkey AS STRING) AS target_id, 'located_in' AS edge_type FROM $customer
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING), 'located_in' FROM $supplier
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), 'part_of' FROM $nation
UNION ALL SELECT DISTINCT 'S' || CAST(l_suppkey AS STRING), 'P' || CAST(l_partkey AS STRING), 'supplies' FROM $lineitem""")
view("g_edges", "SELECT edge_type || ':' || source_id || ':' || target_id AS id, source_id, target_id, edge_type FROM $g_edges0")
# The knowledge graph of the enriched tables.
view("k_edges", """
SELECT record_id AS ord, 'e' || CAST(record_id AS STRING) AS id, source_id, target_id, predicate AS edge_type, confidence
FROM (SELECT DISTINCT record_id, source_id, target_id, predicate, confidence FROM $enriched_relations WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND predicate IS NOT NULL) q""")
view("k_nodes", """
SELECT entity_id AS id, min(lower(trim(label))) AS label, min(lower(trim(entity_type))) AS node_type FROM $enriched_entities WHERE entity_id IS NOT NULL GROUP BY entity_id""")
# Undirected simple projection of the knowledge graph.
view("k_simple", "SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM $k_edges WHERE source_id <> target_id")
# Entities with many repeats: parts by name.
view("entities", "SELECT CAST(p_partkey AS BIGINT) AS ord, 'p' || CAST(p_partkey AS STRING) AS id, p_name AS label, p_type AS entity_type, round(p_size / 50.0, 4) * 1e0 AS confidence FROM $part")
view("evidence", "SELECT DISTINCT 'p' || CAST(l_partkey AS STRING) AS entity_id, 'doc' || CAST(l_suppkey % 7 AS STRING) AS source_id FROM $lineitem")
view("relations", """
SELECT l_orderkey * 10 + l_linenumber AS ord, 'S' || CAST(l_suppkey AS STRING) AS source_id, l_returnflag || l_linestatus AS predicate, 'P' || CAST(l_partkey AS STRING) AS target_id, round(1 - l_discount, 4) AS confidence
FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_discount) AS l_discount FROM $lineitem GROUP BY l_orderkey, l_linenumber) q""")
# Runs: a metric per event type and day; votes by users.
view("runs", "SELECT event_type AS variant, CAST(day(ts) AS INT) AS run_number, round(avg(value), 6) AS value, count(*) AS n, CASE WHEN count(*) % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM $events GROUP BY event_type, day(ts)")
view("votes", "SELECT user_id % 40 AS item_id, user_id AS reviewer, event_type AS decision, min(ts) AS ts FROM $events GROUP BY user_id % 40, user_id, event_type")
# Gold spans and predictions: a share of the gold shifted or relabelled, one in ten repeated.
view("gold_spans", "SELECT DISTINCT entity_key AS id, doc_id, start_char, end_char, lower(label) AS label FROM $gold_entities WHERE start_char IS NOT NULL AND end_char IS NOT NULL AND label IS NOT NULL AND doc_id IS NOT NULL")
view("pred_spans", """
SELECT doc_id, CASE WHEN start_char % 5 = 0 THEN start_char + 1 ELSE start_char END AS start_char, end_char, CASE WHEN end_char % 7 = 0 THEN 'other' ELSE label END AS label FROM $gold_spans
UNION ALL SELECT doc_id, start_char, end_char, label FROM $gold_spans WHERE start_char % 10 = 1""")
# Questions and answers.
view("qa", """
SELECT o_orderkey AS question_id, o_orderpriority AS query_type, CAST(o_orderkey % 5 + 1 AS INT) AS difficulty, o_orderstatus || substr(o_orderpriority, 1, 3) AS expected,
CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_orderstatus || 'xyz' ELSE o_orderstatus || substr(o_orderpriority, 1, 3) END AS answer FROM $orders""")
view("doc_words", "SELECT doc_id, text FROM (SELECT DISTINCT doc_id, text FROM $documents) q WHERE text IS NOT NULL")
view("rankings", """
SELECT user_id AS query_id, event_id AS item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank, event_type IN ('purchase', 'signup') AS relevant FROM $events""")
view("calib", "SELECT doc_id, coalesce(lang, '') AS kind, CASE WHEN doc_id % 3 > 0 THEN 1e0 ELSE 0e0 END AS correct, least(1e0, n_chars / 20000e0) AS confidence FROM (SELECT DISTINCT doc_id, lang, n_chars FROM $documents) q")
view("snap_a", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM $customer WHERE c_custkey % 10 <> 0")
view("snap_b", "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM $customer WHERE c_custkey % 10 <> 1")
