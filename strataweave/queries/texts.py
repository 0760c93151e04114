"""Chunking, retrieval and extraction queries."""

from pyspark.sql import functions as F

from strataweave.functions.text import jaccard, token_count, word_set
from strataweave.operators import chunking as C
from strataweave.operators import extraction as X
from strataweave.operators import retrieval as T
from strataweave.queries.registry import query

Q = "the dose rate in the controlled area"
_TOK = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


_INDEXES: dict = {}


def _built(t, what, table, build):
    """An index of a table, built at its first use in a session."""
    df = getattr(t, table)
    key = (what, df.sparkSession.sparkContext.applicationId, t._path, *df.inputFiles())
    if key not in _INDEXES:
        _INDEXES[key] = build(df)
    return _INDEXES[key]


def text_index(t):
    return _built(t, "words", "doc_words", T.TextIndex.build)


def vector_index(t):
    return _built(t, "vectors", "embeddings", T.VectorIndex.build)


def first_vector(t):
    """The vector of the least key, the query of the dense searches."""
    return vector_index(t).rows.df.orderBy("key").limit(1)


def _bm25(t):
    return text_index(t).scores_of(Q).select("doc_id", F.col("bm25").alias("score"))


def _sparse(t):
    return text_index(t).scores_of(Q).select("doc_id", F.col("jaccard").alias("score"))


@query("C1_fixed_size", f"""
WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 462)) AS s FROM $doc_words WHERE length(text) > 0),
c AS (SELECT doc_id, CASE WHEN s > 0 THEN s - 25 ELSE 0 END AS start_char, least(s + 512, length(text)) AS end_char, text FROM s),
d AS (SELECT doc_id, start_char, end_char, text[start_char + 1:end_char] AS content FROM c)
SELECT doc_id, start_char, end_char, md5(content) AS content, len({_TOK.format(x='content')}) AS token_count FROM d WHERE len({_TOK.format(x='content')}) > 0""")
def c1(t):
    return C.fixed_size(t.doc_words, "doc_id", "text").withColumn("content", F.md5("content"))


@query("C2_packed_paragraphs")
def c2(t):
    return C.packed_paragraphs(t.doc_words, "doc_id", "text").drop("content")


@query("C3_sections", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM $doc_words),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l),
g AS (SELECT doc_id, sec, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS content, max(CASE WHEN sec > 0 AND regexp_matches(line, '^#{1,6}\\s+.+$') THEN regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2) END) AS heading FROM m GROUP BY 1, 2)
SELECT doc_id, heading, length(content) AS n_chars, lead(first - 1) OVER (PARTITION BY doc_id ORDER BY sec) AS section_index FROM g""")
def c3(t):
    return C.sections(t.doc_words, "doc_id", "text").select("doc_id", "heading", F.length("content").alias("n_chars"), "section_index")


@query("C4_hierarchical")
def c4(t):
    return C.hierarchical(t.doc_words, "doc_id", "text").groupBy("hierarchy_level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


@query("C5_token_count", f"SELECT doc_id, len({_TOK.format(x='text')}) AS n_tokens FROM $doc_words")
def c5(t):
    return t.doc_words.select("doc_id", token_count("text").alias("n_tokens"))


@query("C6_ingestion_statistics", f"""
WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 462)) AS s FROM $doc_words WHERE length(text) > 0),
c AS (SELECT doc_id, CASE WHEN s > 0 THEN s - 25 ELSE 0 END AS a, least(s + 512, length(text)) AS e, text FROM s), d AS (SELECT doc_id, e - a AS n, len({_TOK.format(x='text[a + 1:e]')}) AS k FROM c)
SELECT doc_id, count(*) AS n_chunks, sum(k)::BIGINT AS n_tokens, max(n)::BIGINT AS longest FROM d WHERE k > 0 GROUP BY doc_id""")
def c6(t):
    return C.ingestion_statistics(C.fixed_size(t.doc_words, "doc_id", "text"), "doc_id")


_G = "'der', 'die', 'und', 'in', 'zu', 'das', 'mit'"


@query("S16_language", f"SELECT doc_id, CASE WHEN length(text) < 20 THEN 'auto' WHEN len(list_intersect(list_distinct(({_TOK.format(x='lower(text)')})[1:50]), [{_G}])) > 5 THEN 'de' ELSE 'en' END AS lang FROM $doc_words")
def s16(t):
    return t.doc_words.select("doc_id", C.language_of(F.col("text")).alias("lang"))


_QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


@query("T1_dense_top_k", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QV}) DESC, vec_id LIMIT 20")
def t1(t):
    return vector_index(t).top_k(first_vector(t), 20).withColumn("score", F.round("score", 6))


@query("T2_normalised", f"SELECT vec_id, round(greatest(0::DOUBLE, least(1::DOUBLE, (list_cosine_similarity(embedding::DOUBLE[], {_QV}) + 1) / 2)), 6) AS score FROM embeddings")
def t2(t):
    q = t.embeddings.orderBy("vec_id").first()["embedding"]
    return t.embeddings.select("vec_id", F.round(T.normalised(T.cosine(F.col("embedding"), F.array(*map(F.lit, q)))), 6).alias("score"))


_SPARSE = f"SELECT doc_id, len(list_intersect(w, q)) / (len(w) + len(q) - len(list_intersect(w, q))) AS score FROM (SELECT doc_id, list_distinct({_TOK.format(x='lower(text)')}) AS w, list_distinct(string_split('{Q}', ' ')) AS q FROM $doc_words) z WHERE len(list_intersect(w, q)) > 0"


@query("T3_sparse_top_k", f"SELECT doc_id, round(score, 6) AS score FROM ({_SPARSE}) s ORDER BY s.score DESC, doc_id LIMIT 20")
def t3(t):
    return T.best(_sparse(t), 20).withColumn("score", F.round("score", 6))


_BM25 = f"""d AS (SELECT doc_id, {_TOK.format(x='lower(text)')} AS w FROM $doc_words), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
df AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS t FROM d) x GROUP BY t), idf AS (SELECT t, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM df, n),
fl AS (SELECT avg(idf) * 0.25::DOUBLE AS f FROM idf), q AS (SELECT t, count(*) AS m FROM (SELECT unnest(string_split('{Q}', ' ')) AS t) x GROUP BY t),
tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d) x WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
b AS (SELECT doc_id, sum(q.m * CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM tf JOIN idf USING (t) JOIN q USING (t), fl, n GROUP BY doc_id)"""


@query("T7_bm25", f"WITH {_BM25} SELECT doc_id, round(score, 5) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, doc_id LIMIT 50")
def t7(t):
    return T.best(_bm25(t), 50).withColumn("score", F.round("score", 5))


_TOP = f"x AS (SELECT doc_id, score FROM ({_SPARSE}) s ORDER BY score DESC, doc_id LIMIT 40), y AS (SELECT * FROM b WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40)"


@query("T4_weighted_fusion", f"WITH {_BM25}, {_TOP}, j AS (SELECT doc_id, 0.6::DOUBLE * coalesce(y.score, 0) + 0.4::DOUBLE * coalesce(x.score, 0) AS s FROM x FULL JOIN y USING (doc_id)) SELECT doc_id, round(s / (SELECT max(s) FROM j), 5) AS score FROM j")
def t4(t):
    return T.fuse(T.best(_bm25(t), 40), T.best(_sparse(t), 40), per_side=False).withColumn("score", F.round("score", 5))


@query("T8_max_fusion", f"WITH {_BM25}, {_TOP} SELECT doc_id, round(0.6::DOUBLE * coalesce(y.score, 0) / (SELECT max(score) FROM y) + 0.4::DOUBLE * coalesce(x.score, 0) / (SELECT max(score) FROM x), 5) AS score FROM x FULL JOIN y USING (doc_id)")
def t8(t):
    return T.fuse(T.best(_bm25(t), 40), T.best(_sparse(t), 40)).withColumn("score", F.round("score", 5))


@query("hybrid_retrieval", f"WITH {_BM25}, {_TOP} SELECT doc_id, round(0.6::DOUBLE * coalesce(y.score, 0) / (SELECT max(score) FROM y) + 0.4::DOUBLE * coalesce(x.score, 0) / (SELECT max(score) FROM x), 5) AS score FROM x FULL JOIN y USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20")
def t5(t):
    f = T.fuse(T.best(_bm25(t), 40), T.best(_sparse(t), 40)).withColumn("score", F.round("score", 5))
    return T.best(f, 20)


_BATCH = f"""d AS (SELECT doc_id, {_TOK.format(x='lower(text)')} AS w FROM $doc_words), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
df AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS t FROM d) x GROUP BY t), idf AS (SELECT t, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM df, n), fl AS (SELECT avg(idf) * 0.25::DOUBLE AS f FROM idf),
l AS (SELECT DISTINCT text FROM (SELECT pref_label AS text FROM skos_concepts UNION ALL SELECT unnest(alt_labels) FROM skos_concepts) z WHERE text IS NOT NULL),
q AS (SELECT text AS query_id, t, count(*) AS m FROM (SELECT text, unnest({_TOK.format(x='lower(text)')}) AS t FROM l) x GROUP BY 1, 2), nq AS (SELECT query_id, count(*) AS nq FROM q GROUP BY 1),
tf AS (SELECT doc_id, dl, nw, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, len(list_distinct(w)) AS nw, unnest(w) AS t FROM d) x WHERE t IN (SELECT t FROM q) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(m * CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS bm, count(*) / (any_value(nw) + any_value(nq) - count(*)) AS ja
      FROM tf JOIN idf USING (t) JOIN q USING (t) JOIN nq USING (query_id), fl, n GROUP BY 1, 2),
x AS (SELECT query_id, doc_id, ja / max(ja) OVER (PARTITION BY query_id) AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ja DESC, doc_id) AS r FROM s) z WHERE r <= 40),
y AS (SELECT query_id, doc_id, bm / max(bm) OVER (PARTITION BY query_id) AS a FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm DESC, doc_id) AS r FROM s WHERE bm > 0) z WHERE r <= 40),
j AS (SELECT query_id, doc_id, round(0.6::DOUBLE * coalesce(a, 0) + 0.4::DOUBLE * coalesce(b, 0), 5) AS score FROM x FULL JOIN y USING (query_id, doc_id))"""


@query("T5_hybrid_batch", f"WITH {_BATCH} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM j) z WHERE rank <= 20")
def t5_batch(t):
    """The twenty best documents for each label of the concept list, all queries in one pass."""
    labels = t.skos_concepts.select(F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("text")).where("text is not null").distinct()
    return text_index(t).hybrid(labels.withColumn("query_id", F.col("text")), 20)


@query("T7_index_statistics", f"SELECT count(*) AS n_docs, round(avg(len(w)), 6) AS mean_length, (SELECT count(DISTINCT t) FROM (SELECT unnest({_TOK.format(x='lower(text)')}) AS t FROM $doc_words) z) AS n_words FROM (SELECT {_TOK.format(x='lower(text)')} AS w FROM $doc_words) d")
def t7_index(t):
    x = text_index(t)
    return x.postings.df.agg(F.lit(x.n_docs).alias("n_docs"), F.lit(round(x.mean_length, 6)).alias("mean_length"), F.count_distinct("t").alias("n_words"))


@query("T6_query_expansion", "WITH v AS (SELECT user_id AS doc_id, min(value) AS a, max(value) AS b, avg(value) AS c FROM events GROUP BY 1) SELECT doc_id, round(((a + b) / 2 + c) / 2, 6) AS score FROM v")
def t6(t):
    g = t.events.groupBy(F.col("user_id").alias("doc_id")).agg(F.min("value").alias("a"), F.max("value").alias("b"), F.avg("value").alias("c"))
    v = g.select("doc_id", F.posexplode(F.array("a", "b", "c")).alias("variant_no", "score"))
    return T.expand(v).withColumn("score", F.round("score", 6))


@query("T14_ranking_metrics", """
WITH g AS (SELECT query_id, count(*) FILTER (relevant) AS n, count(*) FILTER (relevant AND rank <= 5) AS h5, count(*) FILTER (relevant AND rank <= 10) AS h10, sum(CASE WHEN relevant AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (relevant) AS f, avg(rank) FILTER (relevant) AS m FROM $rankings GROUP BY query_id)
SELECT query_id, round(CASE WHEN n > 0 THEN h5 / n ELSE 0 END, 6) AS recall_5, round(CASE WHEN n > 0 THEN h10 / n ELSE 0 END, 6) AS recall_10, round(h5 / 5, 6) AS precision_5, round(h10 / 10, 6) AS precision_10,
round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_10, round(coalesce(1 / f, 0), 6) AS mrr, round(coalesce(m, 0), 6) AS mean_rank FROM g""")
def t14(t):
    return T.ranking_metrics(t.rankings)


@query("T11_recall_precision", "SELECT query_id, round(count(*) FILTER (relevant AND rank <= 5) / 5, 6) AS precision_5, round(CASE WHEN count(*) FILTER (relevant) > 0 THEN count(*) FILTER (relevant AND rank <= 5) / count(*) FILTER (relevant) ELSE 0 END, 6) AS recall_5 FROM $rankings GROUP BY 1")
def t11(t):
    return T.ranking_metrics(t.rankings).select("query_id", "precision_5", "recall_5")


@query("T12_ndcg", "WITH g AS (SELECT query_id, count(*) FILTER (relevant) AS n, sum(CASE WHEN relevant AND rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM $rankings GROUP BY 1) SELECT query_id, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 3) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_3 FROM g")
def t12(t):
    return T.ranking_metrics(t.rankings, cutoffs=(3,)).select("query_id", "ndcg_3")


@query("T13_mrr", "SELECT query_id, round(coalesce(1 / min(rank) FILTER (relevant), 0), 6) AS mrr, round(coalesce(avg(rank) FILTER (relevant), 0), 6) AS mean_rank FROM $rankings GROUP BY 1")
def t13(t):
    return T.ranking_metrics(t.rankings).select("query_id", "mrr", "mean_rank")


@query("T15_threshold_search", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_QV}) >= 0.1 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QV}) DESC, vec_id LIMIT 50")
def t15(t):
    return vector_index(t).top_k(first_vector(t), 50, 0.1).withColumn("score", F.round("score", 6))


@query("T16_rag_context", f"WITH x AS (SELECT doc_id, score FROM ({_SPARSE}) s ORDER BY score DESC, doc_id LIMIT 5), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM x) SELECT string_agg('[' || r.doc_id || '] ' || substr(text, 1, 400), chr(10) || chr(10) ORDER BY k) AS context, round(avg(score), 6) AS confidence FROM r JOIN $doc_words d USING (doc_id)")
def t16(t):
    return T.context(T.ranked(T.best(_sparse(t), 5)), t.doc_words)


@query("T18_entity_context", "SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM $doc_words WHERE contains(lower(text), 'strahlenschutz') ORDER BY doc_id LIMIT 5")
def t18(t):
    return t.doc_words.where(F.contains(F.lower("text"), F.lit("strahlenschutz"))).select("doc_id", F.lit(1.0).alias("score")).orderBy("doc_id").limit(5)


@query("T19_reference_expansion", "SELECT DISTINCT target_id, 0.8::DOUBLE AS score FROM $k_edges WHERE source_id IN (SELECT source_id FROM $k_edges GROUP BY 1 ORDER BY count(*) DESC, source_id LIMIT 3)")
def t19(t):
    top = t.k_edges.groupBy("source_id").count().orderBy(F.col("count").desc(), "source_id").limit(3)
    return t.k_edges.join(F.broadcast(top), "source_id", "left_semi").select("target_id", F.lit(0.8).alias("score")).distinct()


@query("T20_prompt_format", "SELECT doc_id, '## ' || doc_id || chr(10) || substr(text, 1, 400) AS block FROM $doc_words")
def t20(t):
    return t.doc_words.select("doc_id", F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), F.substring("text", 1, 400)).alias("block"))


@query("Q8_word_jaccard", "SELECT o_orderkey, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS s FROM (SELECT o_orderkey, list_distinct(string_split(lower(o_orderpriority || ' ' || o_orderstatus), ' ')) AS a, list_distinct(string_split(lower('1-URGENT f ' || o_orderstatus), ' ')) AS b FROM orders) q")
def q8(t):
    a, b = word_set(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")), word_set(F.concat(F.lit("1-URGENT f "), F.col("o_orderstatus")))
    return t.orders.select("o_orderkey", F.round(jaccard(a, b), 6).alias("s"))


def _entity_sql():
    """The default patterns as SQL: the pattern tried first wins, then the first place."""
    one = "SELECT id, label, '{t}' AS entity_type, {i} AS no, CAST({c} AS DOUBLE) AS confidence, unnest(regexp_extract_all(label, '{p}')) AS mt FROM n"
    parts = [one.format(t=t, i=i, c=c, p=p.replace("\\w", "[\\pL\\pN_]")) for i, (t, p, c) in enumerate(X.ENTITY_PATTERNS)]
    return f"""WITH n AS (SELECT DISTINCT id, label FROM nodes WHERE label IS NOT NULL), m AS ({" UNION ALL ".join(parts)}), p AS (SELECT *, CAST(strpos(label, mt) - 1 AS INT) AS s, CAST(strpos(label, mt) - 1 + length(mt) AS INT) AS e FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY id, lower(mt), entity_type ORDER BY no, s, e) AS r FROM p)
SELECT id, mt AS label, entity_type, s AS start_char, e AS end_char, confidence, 'char_' || s || '_' || e AS evidence_id FROM f WHERE r = 1"""


@query("E1_rule_entities", _entity_sql())
def e1(t):
    return X.rule_entities(t.nodes.select("id", F.col("label").alias("name")).distinct(), "id", "name")


@query("E2_own_pattern")
def e2(t):
    return X.rule_entities(t.doc_words, "doc_id", "text", (*X.ENTITY_PATTERNS, ("Code", r"[A-Z]{3}-\d{3,4}", 0.8)), ["Code"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("E3_rule_relations")
def e3(t):
    p = (("Activity", r"(?i)\b(?:Zerlegen|Abbau|Umbau|Lagerung)\b", 0.9), ("Component", r"\b(?:Dampferzeugers|Anlagenteile|Lüftung|Gebinde|Pumpen)\b", 0.9))
    return X.rule_relations(t.doc_words, X.rule_entities(t.doc_words, "doc_id", "text", p), "doc_id", "text")


_REFRE = "(§§?\\s*\\d+[a-z]?(?:\\s*(?:bis|und|,)\\s*§?\\s*\\d+[a-z]?)*(?:\\s+(?:Abs(?:atz)?\\.?\\s*\\d+))?(?:\\s+(?:Satz|S\\.)\\s*\\d+)?(?:\\s+(?:Nr\\.?\\s*\\d+))?)"


@query("S8_references", f"SELECT doc_id, unnest(regexp_extract_all(text, '{_REFRE}', 1)) AS reference FROM $doc_words")
def s8(t):
    return X.references(t.doc_words, "doc_id", "text")


@query("E12_legal_entities")
def e12(t):
    return X.legal_entities(t.doc_words, "doc_id", "text")


@query("E13_legal_relations")
def e13(t):
    return X.legal_relations(X.legal_entities(t.doc_words, "doc_id", "text"), "doc_id")


_SPANS = "SELECT DISTINCT doc_id, text AS label, CASE label WHEN 'Person' THEN 'Obligation' WHEN 'Organisation' THEN 'LegalActor' WHEN 'Paragraf' THEN 'LegalReference' ELSE label END AS entity_type FROM {g} WHERE doc_id IS NOT NULL AND label IS NOT NULL AND text IS NOT NULL"


@query("E13_relations_of_spans", f"""WITH e AS ({_SPANS.format(g="gold_entities")})
SELECT doc_id, doc_id AS source, 'referenziert' AS predicate, label AS target, 0.95::DOUBLE AS confidence FROM e WHERE entity_type = 'LegalReference'
UNION ALL SELECT a.doc_id, a.label, 'zustaendig', b.label, 0.855::DOUBLE FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.entity_type = 'Behoerde' AND b.entity_type = 'Obligation'
UNION ALL SELECT a.doc_id, a.label, 'betrifft', b.label, 0.8075::DOUBLE FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.entity_type = 'Obligation' AND b.entity_type = 'LegalActor'""")
def e13_spans(t):
    """All branches, over annotated spans: persons stand for obligations, organisations for actors."""
    return X.legal_relations(t._spark.sql(_SPANS.format(g="{g}"), g=t.gold_entities), "doc_id")


@query("E14_modalities")
def e14(t):
    return X.legal_entities(t.doc_words, "doc_id", "text").where("entity_type in ('Obligation', 'Permission', 'Prohibition')").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("E15b_aligned_confidence", "SELECT ord, round(CASE WHEN ord % 4 IN (0, 1) THEN least(1.0::DOUBLE, confidence + 0.1::DOUBLE) WHEN ord % 4 = 2 THEN confidence * 0.8::DOUBLE ELSE confidence * 0.5::DOUBLE END, 6) AS confidence FROM $entities")
def e15b(t):
    s = F.when(F.col("ord") % 4 == 0, "exact").when(F.col("ord") % 4 == 1, "fuzzy").when(F.col("ord") % 4 == 2, "partial").otherwise("missing")
    return t.entities.select("ord", F.round(X.aligned_confidence(F.col("confidence"), s), 6).alias("confidence"))


@query("E18_alignment")
def e18(t):
    g = t.gold_entities.select("entity_key", "doc_id", F.col("text").alias("snippet")).distinct().join(t.gold_documents.select("doc_id", "text").distinct(), "doc_id")
    return X.align(g, "text", "snippet").select("entity_key", "status", F.round("score", 6).alias("score"))


@query("E24_cooccurrence", "WITH d AS (SELECT DISTINCT doc_id, text FROM gold_documents WHERE text IS NOT NULL), c AS (SELECT concept_id, pref_label AS l FROM skos_concepts UNION SELECT concept_id, unnest(alt_labels) FROM skos_concepts) SELECT DISTINCT doc_id, concept_id FROM d, c WHERE length(trim(l)) > 0 AND contains(lower(text), lower(l))")
def e24(t):
    labels = t.skos_concepts.select("concept_id", F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("l"))
    return X.label_mentions(t.gold_documents.select("doc_id", "text").distinct(), labels, "doc_id", "text", "concept_id", "l").distinct()


_PAIRS = "WITH d AS (SELECT DISTINCT doc_id, text FROM gold_documents WHERE text IS NOT NULL), c AS (SELECT concept_id, pref_label AS l FROM skos_concepts UNION SELECT concept_id, unnest(alt_labels) FROM skos_concepts), m AS (SELECT DISTINCT doc_id, concept_id FROM d, c WHERE length(trim(l)) > 0 AND contains(lower(text), lower(l)))"


@query("E24_cooccurring_pairs", f"{_PAIRS} SELECT a.concept_id AS source_id, b.concept_id AS target_id, count(*) AS n_docs, min(a.doc_id) AS first_doc FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.concept_id < b.concept_id GROUP BY 1, 2")
def e24_pairs(t):
    return X.cooccurring_pairs(e24(t), "doc_id", "concept_id")


@query("E21_extraction_cache", "SELECT count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM (SELECT sha256(text)[1:16] IN (SELECT sha256(text)[1:16] FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) AS hit FROM $doc_words) q")
def e21(t):
    key = F.substring(F.sha2("text", 256), 1, 16)
    cache = t.documents.where("doc_id % 2 = 0 and text is not null").select(key.alias("key")).distinct().withColumn("hit", F.lit(True))
    j = t.doc_words.select(key.alias("key")).join(cache, "key", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("hit_rate"))


@query("E22_output_benchmark", "SELECT variant AS schema, count(*) AS n, round(count(*) FILTER (status = 'completed') / count(*), 6) AS success, count(*) FILTER (status <> 'completed') / count(*) > 0.1 AS many_errors FROM $runs GROUP BY variant")
def e22(t):
    ok = F.count(F.when(F.col("status") == "completed", 1)) / F.count(F.lit(1))
    return t.runs.groupBy(F.col("variant").alias("schema")).agg(F.count(F.lit(1)).alias("n"), F.round(ok, 6).alias("success"), ((1 - ok) > 0.1).alias("many_errors"))


@query("K6_sanitised_labels", "SELECT DISTINCT node_type, CASE WHEN regexp_matches(x, '^[0-9]') THEN '_' || x ELSE x END AS safe FROM (SELECT node_type, replace(replace(replace(node_type, ' ', '_'), '-', '_'), '/', '_') AS x FROM nodes WHERE node_type IS NOT NULL) q")
def k6(t):
    from strataweave.sources.export import safe_label

    return t.nodes.where("node_type is not null").select("node_type", safe_label(F.col("node_type")).alias("safe")).distinct()
