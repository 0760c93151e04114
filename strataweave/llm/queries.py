"""Queries over the test tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import canonical, components, language, mixing, names, neighbours, packing, splitting, survivors, tokens
from strataweave.plans.session import ship


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _typed(spark: SparkSession, d: str, field: str) -> DataFrame:
    """Records of a freely typed field with the entry of its list."""
    if field == "node_type":
        rec = _t(spark, d, "nodes").select(F.col("id").alias("record_key"), F.col("node_type").alias("value"))
        ref = canonical.entry_forms(_t(spark, d, "onto_classes"), "class_id", "class_name", "alt_labels")
    else:
        rec = _t(spark, d, "skos_mappings").select(F.col("mapping_id").cast("string").alias("record_key"), F.col("entity_label").alias("value"))
        ref = canonical.entry_forms(_t(spark, d, "skos_concepts"), "concept_id", "pref_label", "alt_labels")
    return canonical.map_records(rec, ref).withColumn("field_name", F.lit(field))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for field, table, name in (("node_type", "onto_classes", "class_name"), ("entity_label", "skos_concepts", "pref_label")):
        exact = _t(spark, d, table).select(F.col(name).alias("value")).distinct()
        out.append(_typed(spark, d, field).join(exact, "value", "left_anti"))
    return out[0].unionByName(out[1]).select("field_name", "record_key", F.coalesce("entry_id", F.lit("none")).alias("entry_id")).distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that the lists have no entry for, with the number of their records."""
    u = _typed(spark, d, "node_type").unionByName(_typed(spark, d, "entity_label"))
    return u.where("entry_id is null").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_records"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "gold_documents").select("doc_id", "text", "config_name").dropDuplicates()
    c = splitting.with_config(docs, _t(spark, d, "processing_configs"))
    return splitting.split_texts(c, "doc_id", "text", "__size", "__overlap")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized are the documents that the operator cut, unbreakable those in which it had to
    cut a run without white space that is longer than the size."""
    docs = _t(spark, d, "gold_documents").select("doc_id", "text", "config_name")
    c = splitting.with_config(docs, _t(spark, d, "processing_configs"))
    keyed = c.withColumn("key", F.concat_ws("\u0001", "doc_id", F.col("__size").cast("string")))
    p = splitting.split_texts(keyed, "key", "text", "__size", "__overlap", False).where("piece_no > 0 or cut_kind = 'forced'")
    s = p.select(F.split("key", "\u0001")[0].alias("doc_id"), F.split("key", "\u0001")[1].cast("int").alias("size"), "piece_no", "cut_kind", "cut_run")
    kinds = F.array(F.when(F.col("piece_no") > 0, "oversized"), F.when((F.col("cut_kind") == "forced") & (F.col("cut_run") > F.col("size")), "unbreakable"))
    return s.select("doc_id", F.explode(F.array_compact(kinds)).alias("case_kind")).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = survivors.survivors(_t(spark, d, "enriched_entities"), text=False)
    return s.where("grouped and record_id is not null").select("entity_id", "record_id")


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(_t(spark, d, "enriched_entities"))


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return survivors.values_judged_true(_t(spark, d, "enriched_entities"))


def p3_sources(spark: SparkSession, d: str) -> DataFrame:
    return survivors.source_quality(_t(spark, d, "enriched_entities"))


_COLLECTIONS = (("entity", "enriched_entities"), ("relation", "enriched_relations"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = [neighbours.similar_pairs(_t(spark, d, t), "record_id", "semantic_embedding").select(F.lit(c).alias("collection"), "id_a", "id_b") for c, t in _COLLECTIONS]
    return out[0].unionByName(out[1])


def p4_topk(spark: SparkSession, d: str) -> DataFrame:
    out = [neighbours.top_k(_t(spark, d, t), "record_id", "semantic_embedding").select(F.lit(c).alias("collection"), "id", "rank", "neighbour", "cosine") for c, t in _COLLECTIONS]
    return out[0].unionByName(out[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.link_groups(components.candidate_edges(_t(spark, d, "merge_candidates"))).select(F.col("node").alias("node_id"), "group_id")


P5_SQL = """
WITH RECURSIVE c AS (
  SELECT list_sort(list_distinct(list_transform(list_filter(ids, lambda x: x IS NOT NULL), lambda x: lower(trim(x, E' \\t\\n\\r'))))) AS x
  FROM merge_candidates WHERE score IS NOT NULL AND NOT isnan(score) AND score >= 0.85),
e0 AS (SELECT DISTINCT x[1] AS a, unnest(x[2:]) AS b FROM c WHERE len(x) >= 2),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
r(n, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.n)
SELECT n AS node_id, min(g) AS group_id FROM r GROUP BY n
"""


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that name a person or organisation: nodes by the class their freely typed
    type means, gold entities by their label."""
    classes = _t(spark, d, "onto_classes").where("class_name in ('Person', 'Organization')").select(F.col("class_id").alias("entry_id"), F.when(F.col("class_name") == "Person", names.PERSON).otherwise(names.ORGANISATION).alias("kind"))
    typed = _typed(spark, d, "node_type").join(classes, "entry_id").select(F.col("record_key").alias("key"), "kind")
    nodes = _t(spark, d, "nodes").select(F.col("id").alias("key"), F.col("label").alias("text")).join(typed, "key").distinct()
    gold = _t(spark, d, "gold_entities").where("label in ('Person', 'Organisation')").select(F.col("entity_key").alias("key"), "text", F.when(F.col("label") == "Person", names.PERSON).otherwise(names.ORGANISATION).alias("kind"))
    return nodes.select("key", "kind", "text").unionByName(gold.select("key", "kind", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(names.link_names(p7_records(spark, d)))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the group of the name it means."""
    return names.link_names(p7_records(spark, d))


def _counted(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    from strataweave.plans.lineage import materialize

    docs = _t(spark, d, "documents")
    counted = tokens.with_token_count(docs.where("doc_id is not null"), keep)
    one = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", *(c for c in keep if c != "doc_id"))).alias("r"))  # of different rows with one id the longest
    return materialize(one.select("doc_id", *(F.col("r")[c].alias(c) for c in keep if c != "doc_id"), "r.n_tokens"), "tokens")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_counted(spark, d, ["doc_id"]), _t(spark, d, "pack_profiles"))


def p8_utilisation(spark: SparkSession, d: str) -> DataFrame:
    caps = _t(spark, d, "pack_profiles")
    return packing.utilisation(packing.pack(_counted(spark, d, ["doc_id"]), caps), caps)


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_counted(spark, d, ["doc_id", "source"]), _t(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_counted(spark, d, ["doc_id", "source"]), _t(spark, d, "source_targets"))[1]


def _corpus_mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mixture of as many tokens as the documents have."""
    docs = _counted(spark, d, ["doc_id", "source"])
    return mixing.mix(docs, _t(spark, d, "source_targets"), budget=float(docs.agg(F.sum("n_tokens")).first()[0] or 0))


def p9_corpus_selection(spark: SparkSession, d: str) -> DataFrame:
    return _corpus_mix(spark, d)[0]


def p9_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    return _corpus_mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    r = language.identify(docs).where("lang_found is not null").select("doc_id", "declared", "lang_found")
    per = r.groupBy("doc_id").agg(F.first("declared").alias("declared"), F.collect_set("lang_found").alias("langs"))
    right = F.col("declared").isNotNull() & (F.size("langs") == 1) & (F.col("declared") == F.col("langs")[0])
    return per.where(~right).select("doc_id", F.explode("langs").alias("lang_found"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_unmatched, p2_found, p2_pieces, p3_found, p3_survivors, p3_values, p3_sources, p4_found, p4_topk, p5_found, p7_found, p7_groups, p8_packed, p8_utilisation, p9_selection, p9_shares, p9_corpus_selection, p9_corpus_shares, p10_found, p10_segments]
    return {f.__name__: f for f in found}


P2_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, coalesce(config_name, 'default') AS c FROM gold_documents WHERE text IS NOT NULL),
z AS (SELECT d.doc_id, d.text, coalesce(p.chunk_size, 1024) AS size FROM d LEFT JOIN processing_configs p ON p.config_name = d.c)
SELECT DISTINCT doc_id, 'oversized' AS case_kind FROM z WHERE length(text) > size
UNION
SELECT doc_id, 'unbreakable' FROM z WHERE list_max(list_transform(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: length(w))) > size
"""

P3_SQL = r"""
WITH r AS (
  SELECT DISTINCT 'ent_' || sha256(lower(trim(label, E' \t\n\r')) || '::' || lower(trim(entity_type, E' \t\n\r')))[1:12] AS entity_id, record_id,
    CASE WHEN trim(coalesce(description, ''), E' \t\n\r') <> '' AND lower(trim(description, E' \t\n\r')) NOT IN
      ('todo', 'tbd', 'n/a', 'k. a.', '<leer>', '-', 'beschreibung folgt', 'keine beschreibung vorhanden', 'no description available.')
      AND NOT regexp_matches(description, '^Als Sprachmodell kann|^The description of this entity could not')
      AND lower(trim(description, E' \t\n\r')) <> lower(trim(label, E' \t\n\r')) THEN length(trim(description, E' \t\n\r')) END AS d,
    CASE WHEN NOT isnan(discovery_confidence) AND discovery_confidence BETWEEN 0 AND 1 THEN discovery_confidence END AS c,
    CASE WHEN evidence_count >= 0 THEN evidence_count END AS n
  FROM enriched_entities WHERE record_id IS NOT NULL AND label IS NOT NULL AND entity_type IS NOT NULL),
m AS (SELECT entity_id, max(d) AS d, max(c) AS c, max(n) AS n FROM r GROUP BY entity_id HAVING count(DISTINCT record_id) > 1)
SELECT entity_id, min(record_id) AS record_id FROM r JOIN m USING (entity_id, d, c, n) GROUP BY entity_id HAVING count(DISTINCT record_id) = 1
"""

P4_SQL = """
WITH v AS (SELECT DISTINCT 'entity' AS collection, record_id, semantic_embedding::DOUBLE[] AS e FROM enriched_entities UNION
           SELECT DISTINCT 'relation', record_id, semantic_embedding::DOUBLE[] FROM enriched_relations),
u AS (SELECT collection, record_id, e::DOUBLE[64] AS e FROM v WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0)
SELECT a.collection, a.record_id AS id_a, b.record_id AS id_b FROM u a JOIN u b ON a.collection = b.collection AND a.record_id < b.record_id
WHERE array_cosine_similarity(a.e, b.e) >= 0.95
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
