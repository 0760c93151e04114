"""Confidence queries."""

from pyspark.sql import functions as F

from strataweave.operators import confidence as C
from strataweave.queries.registry import query

_ENT = "SELECT e.*, coalesce(k.n_sources, 0) AS n_sources, CASE WHEN e.ord % 6 = 0 THEN '' ELSE e.label END AS description, CASE WHEN e.entity_type LIKE 'A%' OR e.entity_type LIKE 'S%' THEN 'Action' ELSE e.entity_type END AS kind FROM $entities e LEFT JOIN (SELECT entity_id, count(DISTINCT source_id) AS n_sources FROM $evidence GROUP BY entity_id) k ON k.entity_id = e.id"


def _ent(t):
    n = t.evidence.groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("source_id").alias("n_sources"))
    e = t.entities.join(n, "id", "left").fillna(0, ["n_sources"])
    return e.withColumn("description", F.when(F.col("ord") % 6 == 0, "").otherwise(F.col("label"))).withColumn("kind", F.when(F.col("entity_type").rlike("^[AS]"), "Action").otherwise(F.col("entity_type")))


_STATS = "count(confidence) AS n, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, round(min(confidence), 6) AS lo, round(max(confidence), 6) AS hi, " + ", ".join(f"round(quantile_cont(confidence, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))


@query("F1_distribution", f"SELECT {_STATS} FROM $entities")
def f1(t):
    return C.distribution(t.entities)


@query("F2_by_type", f"SELECT entity_type, {_STATS} FROM $entities GROUP BY entity_type")
def f2(t):
    return C.distribution(t.entities, ["entity_type"])


@query("F3_anomalies", "WITH e AS (SELECT source_type AS id, evidence_count * 1.0::DOUBLE AS confidence FROM (SELECT DISTINCT record_id, source_type, evidence_count FROM enriched_entities) q WHERE evidence_count >= 0), q AS (SELECT quantile_cont(confidence, 0.25) AS q1, quantile_cont(confidence, 0.75) AS q3 FROM e) SELECT id, confidence FROM e, q WHERE confidence < q1 - 1.5 * (q3 - q1) OR confidence > q3 + 1.5 * (q3 - q1)")
def f3(t):
    e = t.enriched_entities.select("record_id", "source_type", "evidence_count").distinct().where("evidence_count >= 0")
    return C.anomalies(e.select(F.col("source_type").alias("id"), F.col("evidence_count").cast("double").alias("confidence")))


@query("F4_threshold", "SELECT list_sort(list(confidence))[CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) + 1] AS threshold FROM $entities")
def f4(t):
    return C.recommended_threshold(t.entities, 0.8)


@query("F5_boost", f"SELECT id, round(least(0.99::DOUBLE, confidence + CASE WHEN n_sources >= 2 THEN 0.15::DOUBLE * (n_sources - 1) / 2 ELSE 0 END + CASE WHEN kind IN ('Action', 'Parameter') THEN 0.05::DOUBLE ELSE 0 END), 6) AS confidence FROM ({_ENT}) q")
def f5(t):
    return C.boost(_ent(t), kind="kind").select("id", F.round("confidence", 6).alias("confidence"))


@query("F6_calibrator_fit")
def f6(t):
    return C.fit_calibrator(t.calib).select("kind", "x", F.round("y", 6).alias("y"), "n")


@query("F7_calibrate")
def f7(t):
    c = t.calib
    return C.calibrate(c, C.fit_calibrator(c)).select("doc_id", F.round("calibrated", 6).alias("calibrated"), F.round("uncertainty", 6).alias("uncertainty"))


@query("F8_calibration_stats", "SELECT kind, count(*) AS n, round(min(confidence), 6) AS raw_lo, round(max(confidence), 6) AS raw_hi, round(avg(correct), 6) AS accuracy FROM $calib GROUP BY kind")
def f8(t):
    return t.calib.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("confidence"), 6).alias("raw_lo"), F.round(F.max("confidence"), 6).alias("raw_hi"), F.round(F.avg("correct"), 6).alias("accuracy"))


@query("F9_disputes", "SELECT id, confidence FROM $entities WHERE confidence < 0.75")
def f9(t):
    return C.disputes(t.entities, 0).select("id", "confidence")


_VOTE = "CASE WHEN ord % 3 = 0 THEN round(least(confidence + 0.05::DOUBLE, 0.99::DOUBLE), 6) WHEN ord % 3 = 1 THEN round(greatest(confidence - 0.1::DOUBLE, 0.1::DOUBLE), 6) ELSE round(confidence, 6) END"


@query("F10_vote", f"SELECT id, {_VOTE} AS confidence FROM $entities")
def f10(t):
    e = t.entities.withColumn("ok", F.when(F.col("ord") % 3 == 0, True).when(F.col("ord") % 3 == 1, False))
    return C.vote(e, "ok").select("id", F.round("confidence", 6).alias("confidence"))


@query("F11_vote_batch", f"SELECT id, {_VOTE} AS confidence FROM $entities WHERE confidence < 0.75")
def f11(t):
    ballots = t.entities.select("id", F.when(F.col("ord") % 3 == 0, True).when(F.col("ord") % 3 == 1, False).alias("ok"))
    return C.vote(C.disputes(t.entities).join(ballots, "id", "left"), "ok").select("id", F.round("confidence", 6).alias("confidence"))


@query("F12_quality_filter", f"SELECT id, confidence FROM ({_ENT}) q WHERE confidence >= 0.7 AND n_sources > 0 AND length(description) > 0")
def f12(t):
    return C.quality_filter(_ent(t)).select("id", "confidence")


@query("F13_quality_report", f"""
WITH b AS ({_ENT}), a AS (SELECT * FROM b WHERE confidence >= 0.7 AND n_sources > 0 AND length(description) > 0),
x AS (SELECT (SELECT count(*) FROM b) AS n_before, count(*) AS n_after, round(min(confidence), 6) AS lo, round(max(confidence), 6) AS hi, round(avg(confidence), 6) AS mean FROM a),
s AS (SELECT count(*) AS n_single FROM (SELECT entity_type FROM a GROUP BY entity_type HAVING count(*) = 1) q)
SELECT n_before, n_after, round(1 - n_after / n_before, 6) AS removed, lo, hi, mean, n_single,
concat_ws(', ', CASE WHEN 1 - n_after / n_before > 0.5 THEN 'high removal' END, CASE WHEN n_single > 0 THEN 'singleton types' END, CASE WHEN mean < 0.75 THEN 'low mean' END, CASE WHEN lo < 0.7 THEN 'low minimum' END) AS issues FROM x, s""")
def f13(t):
    e = _ent(t)
    return C.quality_report(e, C.quality_filter(e))


@query("F14_tuning_pipeline", f"SELECT count(*) AS n, round(avg(c), 6) AS mean FROM (SELECT least(0.99::DOUBLE, confidence + CASE WHEN n_sources >= 2 THEN 0.15::DOUBLE * (n_sources - 1) / 2 ELSE 0 END) AS c, n_sources, description FROM ({_ENT}) e) q WHERE c >= 0.6 AND n_sources > 0 AND length(description) > 0")
def f14(t):
    x = C.quality_filter(C.boost(_ent(t)), 0.6)
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))
