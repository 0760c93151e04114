"""Graph and embedding analytics queries."""

from pyspark.sql import functions as F

from strataweave.operators import embeddings as B
from strataweave.operators import structural as A
from strataweave.plans.lineage import materialize
from strataweave.queries.registry import query

_DEG = "WITH d AS (SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM $g_nodes n LEFT JOIN (SELECT target_id, count(*) AS c FROM $g_edges GROUP BY 1) i ON i.target_id = n.id LEFT JOIN (SELECT source_id, count(*) AS c FROM $g_edges GROUP BY 1) o ON o.source_id = n.id)"


@query("A1_degree_centrality", _DEG + " SELECT id, round((in_degree + out_degree) / ((SELECT count(*) FROM d) - 1), 9) AS degree, round(in_degree / ((SELECT count(*) FROM d) - 1), 9) AS in_degree, round(out_degree / ((SELECT count(*) FROM d) - 1), 9) AS out_degree FROM d")
def a1(t):
    return A.degree_centrality(t.g_nodes, t.g_edges).select("id", *(F.round(c, 9).alias(c) for c in ("degree", "in_degree", "out_degree")))


@query("A2_pagerank")
def a2(t):
    return A.pagerank(t.k_nodes, t.k_edges).select("id", F.round("rank", 6).alias("rank"))


@query("A3_eigenvector")
def a3(t):
    return A.eigenvector(t.k_edges).select("id", F.round("x", 4).alias("x"))


@query("A4_hits")
def a4(t):
    h, a = A.hits(t.k_edges)
    return h.withColumnRenamed("x", "hub").join(a.withColumnRenamed("x", "authority"), "id").select("id", F.round("hub", 4).alias("hub"), F.round("authority", 4).alias("authority"))


@query("A5_path_centralities")
def a5(t):
    return A.path_centralities(t.k_edges).select("id", F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 6).alias("closeness"))


@query("A6_non_backtracking")
def a6(t):
    return A.non_backtracking(t.k_edges).select("id", F.round("x", 4).alias("x"))


@query("A7_centrality_summary", _DEG + ", r AS (SELECT in_degree + out_degree AS x, row_number() OVER (ORDER BY in_degree + out_degree) AS k FROM d) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 5) AS std, round(max(x)::DOUBLE, 6) AS hi, round(2 * sum(x * k) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM r")
def a7(t):
    return A.centrality_summary(A.degrees(t.g_nodes, t.g_edges), "degree")


@query("A8_label_propagation")
def a8(t):
    return A.propagate_labels(t.k_edges).groupBy("community").agg(F.count(F.lit(1)).alias("n"))


_CC = "WITH RECURSIVE arcs AS (SELECT a, b FROM $k_simple UNION SELECT b, a FROM $k_simple), ids AS (SELECT source_id AS id FROM $k_edges UNION SELECT target_id FROM $k_edges), r(id, c) AS (SELECT id, id FROM ids UNION SELECT arcs.b, r.c FROM r JOIN arcs ON arcs.a = r.id)"


@query("A9_modularity", "WITH p AS (SELECT id, node_type AS c FROM $k_nodes), j AS (SELECT x.c AS ca, y.c AS cb FROM $k_simple s JOIN p x ON x.id = s.a JOIN p y ON y.id = s.b), m AS (SELECT count(*) AS m FROM $k_simple), d AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM j UNION ALL SELECT cb FROM j) q GROUP BY c), l AS (SELECT ca AS c, count(*) AS l FROM j WHERE ca = cb GROUP BY ca) SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ^ 2), 6) AS modularity, count(*) AS n_communities FROM d LEFT JOIN l USING (c), m")
def a9(t):
    return A.modularity(t.k_edges, t.k_nodes.select("id", F.col("node_type").alias("community")))


@query("A10_topology", _DEG + " SELECT count(*) AS n, (SELECT count(*) FROM $g_edges) AS e, round((SELECT count(*) FROM $g_edges) / (count(*) * (count(*) - 1)), 9) AS density, round(avg(in_degree + out_degree), 6) AS mean_degree, max(in_degree + out_degree) AS max_degree, round(1 + count(*) FILTER (in_degree + out_degree > 0) / sum(CASE WHEN in_degree + out_degree > 0 THEN ln(in_degree + out_degree) END), 6) AS hill_exponent FROM d")
def a10(t):
    return A.topology(t.g_nodes, t.g_edges)


@query("A11_components", _CC + " SELECT id, min(c) AS component FROM r GROUP BY id")
def a11(t):
    return A.components(t.k_edges)


@query("A11_largest_fraction", _CC + ", g AS (SELECT id, min(c) AS c FROM r GROUP BY id) SELECT round(max(n) / sum(n), 6) AS largest_fraction, count(*) AS n_components FROM (SELECT c, count(*) AS n FROM g GROUP BY c) q")
def a11b(t):
    s = A.components(t.k_edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.round(F.max("n") / F.sum("n"), 6).alias("largest_fraction"), F.count(F.lit(1)).alias("n_components"))


@query("A12_path_lengths")
def a12(t):
    return A.path_lengths(t.k_edges)


_TRI = "WITH e AS (SELECT a, b FROM $k_simple), n AS (SELECT id FROM $k_nodes), t AS (SELECT x.a AS i, x.b AS j, y.b AS k FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), c AS (SELECT id, count(*) AS t FROM (SELECT i AS id FROM t UNION ALL SELECT j FROM t UNION ALL SELECT k FROM t) q GROUP BY id), d AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) q GROUP BY id), f AS (SELECT n.id, coalesce(d, 0) AS d, coalesce(t, 0) AS t FROM n LEFT JOIN d USING (id) LEFT JOIN c USING (id))"


@query("A13_clustering", _TRI + " SELECT round(avg(CASE WHEN d > 1 THEN t / (d * (d - 1) / 2) ELSE 0 END), 6) AS mean_clustering, round(sum(t) / sum(d * (d - 1) / 2), 6) AS transitivity FROM f")
def a13(t):
    return A.clustering(t.k_nodes, t.k_edges)


@query("A14_reciprocity", "WITH e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM $k_edges WHERE source_id <> target_id) SELECT round(count(*) FILTER (EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a)) / count(*), 6) AS reciprocity FROM e".replace("count(*) FILTER (EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a))", "(SELECT count(*) FROM e x JOIN e y ON x.a = y.b AND x.b = y.a)"))
def a14(t):
    return A.reciprocity(t.k_edges)


@query("A15_assortativity", "WITH r AS (SELECT a, b FROM $k_simple UNION ALL SELECT b, a FROM $k_simple), d AS (SELECT a AS id, count(*) AS d FROM r GROUP BY a) SELECT round(corr(x.d, y.d), 6) AS assortativity FROM r JOIN d x ON x.id = r.a JOIN d y ON y.id = r.b")
def a15(t):
    return A.assortativity(t.k_edges)


@query("A16_bridges")
def a16(t):
    return A.bridges(t.k_edges)


@query("A17_structural_suite")
def a17(t):
    n, e = t.k_nodes, t.k_edges
    return A.topology(n, e).crossJoin(A.clustering(n, e)).crossJoin(A.reciprocity(e)).crossJoin(A.assortativity(e))


@query("A18_power_law")
def a18(t):
    return A.power_law(t.k_nodes, t.k_edges)


_NMI = "WITH j AS (SELECT a, b, count(*) AS c FROM ({src}) q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b), n AS (SELECT sum(c) AS n FROM j), ha AS (SELECT -sum(k / n * ln(k / n)) AS h FROM (SELECT sum(c) AS k FROM j GROUP BY a) q, n), hb AS (SELECT -sum(k / n * ln(k / n)) AS h FROM (SELECT sum(c) AS k FROM j GROUP BY b) q, n), hj AS (SELECT -sum(c / n * ln(c / n)) AS h FROM j, n) SELECT round(2 * (ha.h + hb.h - hj.h) / (ha.h + hb.h), 6) AS nmi FROM ha, hb, hj"


@query("A19_nmi", _NMI.format(src="SELECT edge_type AS a, node_type AS b FROM $k_edges e JOIN $k_nodes n ON n.id = e.source_id"))
def a19(t):
    j = t.k_edges.join(t.k_nodes.select(F.col("id").alias("source_id"), "node_type"), "source_id")
    return A.mutual_information(j, "edge_type", "node_type")


@query("A19_contingency", "SELECT edge_type, node_type, count(*) AS n FROM $k_edges e JOIN $k_nodes k ON k.id = e.source_id GROUP BY 1, 2")
def a19b(t):
    return t.k_edges.join(t.k_nodes.select(F.col("id").alias("source_id"), "node_type"), "source_id").groupBy("edge_type", "node_type").agg(F.count(F.lit(1)).alias("n"))


@query("A8_louvain")
def a8_louvain(t):
    return A.louvain(t.k_edges)


@query("A8_greedy_modularity")
def a8_greedy(t):
    return A.greedy_modularity(t.k_edges)


@query("A8_modularity_by_method")
def a8_methods(t):
    """Communities and modularity of the three methods, over simple edges that are written once."""
    edges, out = materialize(A.simple(t.k_edges).select(F.col("a").alias("source_id"), F.col("b").alias("target_id")), "edges"), None
    for name, f in (("louvain", A.louvain), ("label_propagation", A.propagate_labels), ("greedy_modularity", A.greedy_modularity)):
        one = A.modularity(edges, f(edges)).select(F.lit(name).alias("method"), F.round("modularity", 6).alias("modularity"), "n_communities")
        out = one if out is None else out.unionByName(one)
    return out


@query("A20_baseline_modularity")
def a20(t):
    return A.baseline_modularity(t.k_edges, t.k_nodes.select("id", F.col("node_type").alias("community")))


@query("A21_small_world")
def a21(t):
    return A.small_world(t.k_nodes, t.k_edges)


@query("A21_small_world_sampled")
def a21_sampled(t):
    """Over the graph of concepts, which is small enough for the random graphs."""
    e = t.skos_concepts.where("broader_id is not null").select(F.col("concept_id").alias("source_id"), F.col("broader_id").alias("target_id"), F.lit("broader").alias("edge_type"), F.concat_ws(":", "concept_id", "broader_id").alias("id"))
    return A.small_world_sampled(t.skos_concepts.select(F.col("concept_id").alias("id")), e)


@query("A22_bootstrap")
def a22(t):
    return A.bootstrap_density(t.k_edges)


@query("A23_type_degrees", _DEG + " SELECT node_type, count(*) AS n, round(avg(in_degree + out_degree), 6) AS mean, round(quantile_cont(in_degree + out_degree, 0.5), 6) AS median, round(stddev_pop(in_degree + out_degree), 6) AS std, min(in_degree + out_degree) AS lo, max(in_degree + out_degree) AS hi FROM d JOIN $g_nodes USING (id) GROUP BY node_type")
def a23(t):
    return A.type_degree_statistics(t.g_nodes, t.g_edges)


@query("A24_metric_snapshot", _DEG + ", m AS (SELECT avg(in_degree + out_degree) AS m FROM d) SELECT count(*) AS n, round(avg(CASE WHEN node_type IS NULL OR trim(node_type) = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS typed, count(*) FILTER (in_degree + out_degree = 0) AS orphans, round(avg(in_degree + out_degree), 6) AS mean_degree, max(in_degree + out_degree) AS max_degree, count(*) FILTER (in_degree + out_degree > 2 * m) AS hubs, count(*) FILTER (label IS NULL OR trim(label) = '') AS unlabelled FROM d JOIN $g_nodes USING (id), m")
def a24(t):
    return A.metric_snapshot(t.g_nodes, t.g_edges)


@query("A26_setting_profile", "SELECT variant AS setting, 'mean' AS metric, round(avg(value), 6) AS value FROM $runs GROUP BY 1 UNION ALL SELECT variant, 'max', round(max(value), 6) FROM $runs GROUP BY 1 UNION ALL SELECT variant, 'n', round(sum(n)::DOUBLE, 6) FROM $runs GROUP BY 1")
def a26(t):
    from strataweave.operators.experiments import setting_profile

    return setting_profile(t.runs)


@query("A27_compare_settings", """
WITH p AS (SELECT variant AS setting, 'mean' AS metric, avg(value) AS value FROM $runs GROUP BY 1 UNION ALL SELECT variant, 'max', max(value) FROM $runs GROUP BY 1),
z AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS r, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM p)
SELECT setting, round(sum(CASE WHEN metric = 'mean' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END), 6) AS score, min(r) AS best_rank FROM z GROUP BY setting""")
def a27(t):
    from strataweave.operators.experiments import compare_settings, setting_profile

    return compare_settings(setting_profile(t.runs, places=None).where("metric in ('mean', 'max')"), {"mean": 0.7, "max": 0.3})


@query("B1_collect_embeddings", "SELECT count(*) AS n FROM (SELECT DISTINCT record_id FROM enriched_entities WHERE semantic_embedding IS NOT NULL AND len(semantic_embedding) = 64) q")
def b1(t):
    return B.collect(t.enriched_entities, "record_id", "semantic_embedding", 64).agg(F.count(F.lit(1)).alias("n"))


@query("B2_kmeans")
def b2(t):
    return B.kmeans(t.embeddings, "vec_id", "embedding").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("B2_cluster_quality")
def b2_quality(t):
    c = B.kmeans(t.embeddings, "vec_id", "embedding")
    return B.cluster_quality(t.embeddings.select("vec_id", "embedding").join(c, "vec_id"), "vec_id", "embedding", "cluster")


@query("B4_pca")
def b4(t):
    return B.pca(t.embeddings, "vec_id", "embedding", 2)


@query("B5_ari", "WITH j AS (SELECT label AS a, vec_id % 10 AS b, count(*)::DOUBLE AS c FROM embeddings GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c) AS n FROM j), x AS (SELECT sum(k * (k - 1) / 2) AS x FROM (SELECT sum(c) AS k FROM j GROUP BY a) q), y AS (SELECT sum(k * (k - 1) / 2) AS y FROM (SELECT sum(c) AS k FROM j GROUP BY b) q) SELECT round((s - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM s, x, y")
def b5(t):
    return A.pair_counts(t.embeddings.withColumn("p", F.col("vec_id") % 10), "label", "p")


@query("B5_nmi", _NMI.format(src="SELECT label AS a, vec_id % 10 AS b FROM embeddings"))
def b5b(t):
    return A.mutual_information(t.embeddings.withColumn("p", F.col("vec_id") % 10), "label", "p")


@query("B5_mismatched", "SELECT vec_id FROM embeddings WHERE label <> vec_id % 10 ORDER BY vec_id LIMIT 50")
def b5c(t):
    return t.embeddings.where("label <> vec_id % 10").select("vec_id").orderBy("vec_id").limit(50)


@query("B6_coherence", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings) SELECT a.label, round(avg(array_cosine_similarity(a.e, b.e)), 5) AS coherence FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def b6(t):
    return B.coherence(t.embeddings, "label", "embedding", 64).select("label", F.round("coherence", 5).alias("coherence"))


@query("B8_walk_embedding")
def b8(t):
    return B.walk_cooccurrence(t.k_edges).groupBy("u").agg(F.count(F.lit(1)).alias("n_contexts"))


@query("B8_svd_embedding")
def b8_svd(t):
    return B.walk_embedding(t.k_edges)


@query("B9_structural_vs_semantic")
def b9(t):
    v = t.embeddings.select("vec_id", "embedding")
    return B.neighbour_agreement(v, v.withColumn("embedding", F.slice("embedding", 1, 32)), "vec_id", "embedding", 5)
