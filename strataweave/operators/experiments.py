"""Evaluation, experiment comparison, discovery control and review routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataweave.functions.text import positional_similarity


def entity_prf(gold: DataFrame, pred: DataFrame, with_label: bool = True) -> DataFrame:
    """One row: every prediction on a gold span (and label) counts; missed are distinct gold spans."""
    on = ["doc_id", "start_char", "end_char"] + (["label"] if with_label else [])
    g, p = gold.select(*on).distinct(), pred.select(*on)
    tp = p.join(g, on, "left_semi").agg(F.count(F.lit(1)).alias("tp"))
    n = p.agg(F.count(F.lit(1)).alias("n_pred"))
    fn = g.join(p, on, "left_anti").agg(F.count(F.lit(1)).alias("fn"))
    return _prf(tp.crossJoin(n).crossJoin(fn).select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), "fn"))


def relation_prf(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row, over distinct (subject, predicate, object)."""
    g, p = gold.distinct(), pred.distinct()
    on = g.columns
    x = p.join(g, on, "left_semi").agg(F.count(F.lit(1)).alias("tp")).crossJoin(p.join(g, on, "left_anti").agg(F.count(F.lit(1)).alias("fp"))).crossJoin(g.join(p, on, "left_anti").agg(F.count(F.lit(1)).alias("fn")))
    return _prf(x)


def _prf(x: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return x.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def qa_metrics(qa: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query_type, difficulty, n, accuracy, coverage): overall, by type and by difficulty.
    An answer is correct from a positional similarity of ``threshold`` on."""
    ok = F.col("answer").isNotNull() & (positional_similarity(F.col("answer"), F.col("expected")) >= threshold)
    x = qa.select("query_type", "difficulty", F.coalesce(ok, F.lit(False)).alias("ok"), F.col("answer").isNotNull().alias("answered"))
    rows = F.array(*(F.struct(a.alias("query_type"), b.alias("difficulty")) for a, b in ((F.lit(None).cast("string"), F.lit(None).cast("int")), (F.col("query_type"), F.lit(None).cast("int")), (F.lit(None).cast("string"), F.col("difficulty")))))
    y = x.select(F.explode(rows).alias("k"), "ok", "answered")
    return y.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("answered").cast("int")), 6).alias("coverage")).select("k.query_type", "k.difficulty", "n", "accuracy", "coverage")


def convergence(runs: DataFrame) -> DataFrame:
    """Per variant in run order: mean, deviation, range, last less first, and whether the last step is under 1 %."""
    w = W.partitionBy("variant").orderBy("run_number")  # the runs of one variant
    x = runs.withColumn("prev", F.lag("value").over(w))
    g = x.groupBy("variant").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min_by("value", "run_number").alias("first"), F.max_by("value", "run_number").alias("last"), F.max_by("prev", "run_number").alias("prev"))
    return g.select("variant", *(F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "hi")), F.round(F.col("last") - F.col("first"), 6).alias("improvement"), F.coalesce(F.abs(F.col("last") - F.col("prev")) < 0.01 * F.abs("prev"), F.lit(False)).alias("plateau"))


def variant_comparison(runs: DataFrame) -> DataFrame:
    """(variant, rank, mean, margin to the next): one row per variant."""
    m = runs.groupBy("variant").agg(F.avg("value").alias("mean"))
    w = W.orderBy(F.col("mean").desc(), "variant")  # one row per variant
    return m.select("variant", F.row_number().over(w).alias("rank"), F.round("mean", 6).alias("mean"), F.round(F.col("mean") - F.lead("mean").over(w), 6).alias("margin"))


def run_statistics(runs: DataFrame) -> DataFrame:
    ok = F.col("status") == "completed"
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.count(F.when(ok, 1)).alias("n_completed"), F.count(F.when(~ok, 1)).alias("n_failed"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.avg(ok.cast("int")), 6).alias("success_rate"))


def setting_profile(runs: DataFrame, places: int | None = 6) -> DataFrame:
    """(setting, metric, value) in long form."""
    r = (lambda c: F.round(c, places)) if places is not None else (lambda c: c)
    g = runs.groupBy(F.col("variant").alias("setting")).agg(r(F.avg("value")).alias("mean"), r(F.max("value")).alias("max"), r(F.sum("n").cast("double")).alias("n"))
    return g.unpivot(["setting"], ["mean", "max", "n"], "metric", "value")


def compare_settings(profile: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(setting, score, best_rank): min-max normalised metrics, weighted over those present."""
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = W.partitionBy("metric")  # one row per setting
    x = profile.withColumn("w", F.coalesce(m[F.col("metric")], F.lit(0.0))).withColumn("lo", F.min("value").over(w)).withColumn("hi", F.max("value").over(w)).withColumn("r", F.rank().over(w.orderBy(F.col("value").desc())))
    part = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return x.groupBy("setting").agg(F.round(F.sum(F.col("w") * part) / F.sum(F.abs("w")), 6).alias("score"), F.min("r").alias("best_rank"))


def forward_filled(runs: DataFrame) -> DataFrame:
    """(run_number, mean, std) over variants, each variant keeping its last value where it has none.

    The value carried to a run is looked up as the latest at or before it; the spine is the
    distinct run numbers (few) times the variants (few)."""
    spine = runs.select("variant").distinct().crossJoin(runs.select("run_number").distinct())
    x = spine.join(runs.select("variant", "run_number", "value"), ["variant", "run_number"], "left")
    w = W.partitionBy("variant").orderBy("run_number").rowsBetween(W.unboundedPreceding, 0)
    y = x.withColumn("v", F.last("value", ignorenulls=True).over(w))
    return y.groupBy("run_number").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


def distribution_change(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, before, after, change, percent, status) of the counts of two snapshots."""
    n = lambda d, c: d.groupBy(key).agg(F.count(F.lit(1)).alias(c))
    j = n(a, "before").join(n(b, "after"), key, "full_outer").fillna(0, ["before", "after"])
    return j.select(key, "before", "after", (F.col("after") - F.col("before")).alias("change"), F.round(F.try_divide(100.0 * (F.col("after") - F.col("before")), F.col("before").cast("double")), 4).alias("percent"), F.when(F.col("before") == 0, "new").when(F.col("after") == 0, "lost").otherwise("kept").alias("status"))


def coverage(found: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """One row: distinct found types among the classes / classes."""
    hit = found.select(kind).distinct().join(classes.select(kind).distinct(), kind, "left_semi").agg(F.count(F.lit(1)).alias("k"))
    return hit.crossJoin(classes.agg(F.count_distinct(kind).alias("n"))).select("k", "n", F.round(F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0), 6).alias("coverage"))


def questions_for_gaps(found: DataFrame, classes: DataFrame, kind: str, least: int = 1) -> DataFrame:
    n = found.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return classes.select(kind).distinct().join(n, kind, "left").fillna(0, ["n"]).where(F.col("n") < least).select(kind, F.format_string("Which instances of %s are mentioned in the documents?", kind).alias("question"))


def priority(level: Column, domain: Column, relations: Column) -> Column:
    return 0.5 * (1 - level / 10) + 0.3 * domain + 0.2 * relations


def stopping(answerable: Column, valid: Column, confidence: Column, entities: Column, iteration: Column, most: int = 10, need=(0.85, 0.9, 0.7, 10)) -> tuple[Column, Column]:
    """(stop, reason): four gates; at the last iteration it stops anyway. The reason names the
    first gate that isn't met: questions, validation, confidence, count."""
    met = (answerable >= need[0]) & (valid >= need[1]) & (confidence >= need[2]) & (entities >= need[3])
    reason = F.when(met, "all met").when(iteration >= most, "max iterations").when(answerable < need[0], "questions").when(valid < need[1], "validation").when(confidence < need[2], "confidence").otherwise("count")
    return met | (iteration >= most), reason


def consensus(votes: DataFrame, item: str = "item_id", least: int = 3) -> DataFrame:
    """(item, decision, n): the decision most voted for once there are enough reviewers; of
    equals the one voted first."""
    per = votes.groupBy(item, "decision").agg(F.count(F.lit(1)).alias("c"), F.min("ts").alias("first"))
    total = votes.groupBy(item).agg(F.count_distinct("reviewer").alias("n"))
    best = per.groupBy(item).agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "decision")).alias("b"))
    return best.join(total, item).where(F.col("n") >= least).select(item, F.col("b.decision").alias("decision"), "n")


def unknown_types(found: DataFrame, classes: DataFrame, kind: str, least: int = 3) -> DataFrame:
    """(type, n, suggested): non-empty types not in the ontology, case apart."""
    f = found.where(F.length(F.trim(kind)) > 0).groupBy(F.lower(F.trim(kind)).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return f.join(classes.select(F.lower(kind).alias("type")).distinct(), "type", "left_anti").withColumn("suggested", F.col("n") >= least)


def route_feedback(feedback: DataFrame) -> DataFrame:
    """(item, target): accepted or modified feedback, by its type's target."""
    kind = F.when(F.col("feedback_type").startswith("tbox"), "TBox").when(F.col("feedback_type").startswith("abox"), "ABox").otherwise("CQ")
    return feedback.where(F.col("decision").isin("accepted", "modified")).select("item_id", kind.alias("target"))


def type_constraint_scores(entities: DataFrame, classes: list[str], kind: str) -> DataFrame:
    """(type, class, score): 1 for the same, .5 for one inside the other, else left out; the
    class list goes into the plan as literals, types are made distinct first."""
    t = entities.where(F.length(kind) > 0).select(F.lower(kind).alias("type")).distinct()
    x = t.select("type", F.explode(F.array(*(F.lit(c.lower()) for c in classes))).alias("class"))
    s = F.when(F.col("type") == F.col("class"), 1.0).when(F.contains("type", "class") | F.contains("class", "type"), 0.5)
    return x.withColumn("score", s).where("score is not null")
