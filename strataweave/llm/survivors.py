"""Best representative of each duplicate group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import entity_id, norm, strip
from strataweave.plans.lineage import Stage, write_stage
from strataweave.plans.skew import hot_keys, join_unique

# Descriptions that say there is none, as they read in lower case with
# single blanks; and the openings of longer notices.
PLACEHOLDERS = (
    "todo", "tbd", "tba", "tbc", "n/a", "na", "n.a.", "n. a.", "none", "null", "nan", "nil", "unknown", "unbekannt", "k. a.", "k.a.", "keine angabe", "keine angaben", "keine", "leer", "<leer>", "<empty>", "<none>", "<null>",
    "empty", "fixme", "xxx", "test", "lorem ipsum", "placeholder", "platzhalter", "beschreibung folgt", "folgt", "to be done", "to be defined", "to follow", "no description", "no description available",
    "no description available.", "keine beschreibung", "keine beschreibung vorhanden", "keine beschreibung verfügbar", "description missing", "missing description", "beschreibung fehlt", "noch offen", "wird ergänzt", "wird nachgereicht",
)
NOTICES = (
    r"^(als (ki|sprachmodell|ki-sprachmodell)\b|as an? (ai|language model|ai language model)\b)",
    r"^(the|this|no|a) description\b.*\b(could not|cannot|can't|was not|is not|has not|will be|missing|unavailable|available|pending)\b",
    r"^(die|diese|eine) beschreibung\b.*\b(konnte|kann|wurde|wird|ist)\b.*\b(nicht|fehlt|folgt|nachgereicht|noch)\b",
    r"^(keine|no) (beschreibung|description|angabe|information)\b.{0,40}$",
    r"^(error|fehler|timeout|exception)\b",
)

FIELDS = ("description", "discovery_confidence", "evidence_count", "label", "entity_type")

#: Where sensitivity and false-positive rate start, and the records that this start weighs for
#: a source without data.
SENSITIVITY, FALSE_POSITIVE, RECORDS = 0.5, 0.2, 100.0
#: Where the share of true values among a field's usable ones starts.
TRUTH = 0.8
#: The weight that these starts keep against the data when rates and shares are estimated anew:
#: as much as the data. Most values have one source only; with less weight nothing ties the
#: rates, and the rounds drift to calling usable values false.
START_WEIGHT = 1.0
#: The rounds end when no rate moves by more than this.
TOLERANCE = 1e-3


def real_description(text: Column, label: Column) -> Column:
    """True unless the text is null, blank, a placeholder or notice of a missing
    description, or only repeats the label. A text that was cut off is real."""
    t = F.regexp_replace(norm(text), r"(?U)\s+", " ")
    bare = F.regexp_replace(t, r"(?U)[^\w]+", "")
    bad = (bare == "") | t.isin(*PLACEHOLDERS)
    for p in NOTICES:
        bad = bad | t.rlike("(?iu)" + p)
    same = bare == F.regexp_replace(norm(label), r"(?U)[^\w]+", "")
    return F.coalesce(~bad & ~F.coalesce(same, F.lit(False)), F.lit(False))


def prepared(df: DataFrame) -> DataFrame:
    """The fields used, with the identity of the record's entity and which values are usable."""
    conf, n = F.col("discovery_confidence"), F.col("evidence_count")
    return df.select(
        entity_id(F.coalesce("label", F.lit("")), F.coalesce("entity_type", F.lit(""))).alias("entity_id"),
        "record_id",
        F.coalesce("source_type", F.lit("?")).alias("source"),
        strip("label").alias("label"),
        strip("entity_type").alias("entity_type"),
        strip("description").alias("description"),
        real_description(F.col("description"), F.col("label")).alias("real"),
        conf.alias("conf"),
        F.coalesce(~F.isnan(conf) & (conf >= 0) & (conf <= 1), F.lit(False)).alias("conf_ok"),
        n.alias("n"),
        F.coalesce(n >= 0, F.lit(False)).alias("n_ok"),
        F.col("discovered_at").alias("at"),
    ).where(F.col("record_id").isNotNull())


def slim(df: DataFrame) -> Stage:
    """``prepared`` with the description as its hash and length, written once: all steps read that,
    and ``with_text`` puts the text of the surviving ones back."""
    rows = prepared(df).withColumns({"length": F.length("description"), "description": F.hex(F.xxhash64("description"))})
    return write_stage(rows, "records")


def with_text(out: DataFrame, df: DataFrame, value: str) -> DataFrame:
    """``out`` (entity_id, ...) with the description whose hash is ``value`` in its place; ``df`` are
    the records as given."""
    t = prepared(df).select("entity_id", F.hex(F.xxhash64("description")).alias("__h"), F.col("description").alias("__t"))
    need = out.where(F.col(value).isNotNull()).select("entity_id", F.col(value).alias("__h"))
    text = t.join(need, ["entity_id", "__h"], "left_semi").groupBy("entity_id", "__h").agg(F.max("__t").alias("__t"))
    return out.withColumn("__h", F.col(value)).join(text, ["entity_id", "__h"], "left").withColumn(value, F.col("__t")).drop("__h", "__t")


def facts(rows: DataFrame) -> Stage:
    """A written row per distinct value of a field of an entity: the sources that assert it, those
    that cover the field but don't, whether it is usable, and its completeness."""
    f = lambda name, value, ok, measure: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), ok.alias("ok"), measure.cast("double").alias("measure"))
    one = F.lit(1.0)
    fields = F.array(
        f("description", F.col("description"), F.col("real"), F.col("length")),
        f("discovery_confidence", F.col("conf"), F.col("conf_ok"), F.col("conf")),
        f("evidence_count", F.col("n"), F.col("n_ok"), F.col("n")),
        f("label", F.col("label"), F.col("label") != "", one),
        f("entity_type", F.col("entity_type"), F.col("entity_type") != "", one),
    )
    # a description goes through the shuffles as its hash; ``with_text`` puts the text back
    claims = rows.where("record_id is not null").select("entity_id", "source", "at", F.explode(fields).alias("f")).where("f.value is not null").select("entity_id", "source", "at", "f.*")
    values = claims.groupBy("entity_id", "field", "value").agg(F.max("ok").alias("ok"), F.max("measure").alias("measure"), F.array_sort(F.collect_set("source")).alias("yes"), F.max("at").alias("at"))
    written = write_stage(values, "values")
    values = written.df.withColumn("covered", F.concat_ws("|", "field", "entity_id"))
    cover = values.select("covered", F.explode("yes").alias("s")).groupBy("covered").agg(F.collect_set("s").alias("all"))
    out = write_stage(join_unique(values, cover, "covered").withColumn("no", F.array_sort(F.array_except("all", "yes"))).drop("covered", "all"), "facts")
    written.drop()
    return out


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def infer_quality(all_facts: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, Stage, Stage]:
    """(facts with the posterior p of every value, written table (k, sens, fpr) with k = field|source,
    written posteriors, which the first reads) by expectation-maximisation until no rate moves by more than ``tolerance``.

    Latent truth per value; per field and source a sensitivity (asserts a true value) and a
    specificity (doesn't assert a false one); per field the share of true values among the
    usable ones, estimated in every round. Values that can't be true are observed as false.
    The likelihood depends on a value only through who asserts and who denies it, so all
    values are first counted by that pattern and the rounds run over patterns. Rates stay
    tables, for any number of sources; a round brings one number and one row a field to
    the driver.
    """
    pattern = ("field", "yes", "no", "ok")
    known = all_facts.withColumn("pattern", F.xxhash64(*pattern))
    tell = F.concat(F.transform("yes", lambda s: F.struct(F.concat_ws("|", "field", s).alias("k"), F.lit(1).alias("y"))), F.transform("no", lambda s: F.struct(F.concat_ws("|", "field", s).alias("k"), F.lit(0).alias("y"))))
    counted = known.groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.first(c).alias(c) for c in pattern))
    patterns = write_stage(counted.select("pattern", "n", "field", "ok", tell.alias("tells")), "patterns")
    tells = patterns.df.select("pattern", F.explode("tells").alias("t")).select("pattern", "t.*")
    hot = hot_keys(tells, "k")[0]
    truth, rates = {f: TRUTH for f in FIELDS}, None

    def posteriors() -> DataFrame:
        prior = F.lit(0.0)
        for f, share in truth.items():
            prior = F.when(F.col("field") == f, _logit(share)).otherwise(prior)
        if rates is None:
            return patterns.df.withColumn("p", F.when(F.col("ok"), 1 / (1 + F.exp(-prior))).otherwise(0.0))
        told = F.when(F.col("y") == 1, F.log(F.col("sens") / F.col("fpr"))).otherwise(F.log((1 - F.col("sens")) / (1 - F.col("fpr"))))
        odds = join_unique(tells, rates.df.select("k", "sens", "fpr"), "k", hot=hot).groupBy("pattern").agg(F.sum(told).alias("odds"))
        return patterns.df.join(odds, "pattern").withColumn("p", F.when(F.col("ok"), 1 / (1 + F.exp(-(prior + F.col("odds"))))).otherwise(0.0))

    while True:
        own = F.when(F.col("ok"), F.array(F.struct(F.col("field").alias("k"), F.lit(1).alias("y")))).otherwise(F.array().cast("array<struct<k:string,y:int>>"))
        seen = posteriors().select("n", "p", F.explode(F.concat("tells", own)).alias("t"))
        part = lambda y, w: F.sum(F.when(F.col("t.y") == y, F.col("n") * w).otherwise(0.0))
        true, false = F.col("p"), 1 - F.col("p")
        sums = seen.groupBy("t.k").agg(part(1, true).alias("tp"), part(0, true).alias("fn"), part(1, false).alias("fp"), part(0, false).alias("tn"))
        rate = lambda hit, miss, start: (F.col(hit) + start * (START_WEIGHT * (F.col(hit) + F.col(miss)) + RECORDS)) / ((1 + START_WEIGHT) * (F.col(hit) + F.col(miss)) + RECORDS)
        new = sums.select("k", "tp", "fp", rate("tp", "fn", SENSITIVITY).alias("sens"), rate("fp", "tn", FALSE_POSITIVE).alias("fpr"))
        if rates is not None:
            new = new.join(rates.df.select("k", F.col("sens").alias("s0"), F.col("fpr").alias("f0")), "k")
        moved = F.greatest(F.abs(F.col("sens") - F.col("s0")), F.abs(F.col("fpr") - F.col("f0"))) if rates is not None else F.lit(1.0)
        nxt = write_stage(new.select("k", "tp", "fp", "sens", "fpr", moved.alias("moved")), "rates")
        if rates is not None:
            rates.drop()
        rates = nxt
        most = None
        own_row = F.when(F.col("k").isin(*FIELDS), F.col("k"))  # a field's own row has its share of true values
        for r in rates.df.groupBy(own_row.alias("field")).agg(F.max("moved").alias("moved"), F.max("tp").alias("tp"), F.max("fp").alias("fp")).collect():
            if r["field"] is None:
                most = max(most or 0.0, r["moved"])
            else:
                n = r["tp"] + r["fp"]
                share = (r["tp"] + START_WEIGHT * n * TRUTH) / (n * (1 + START_WEIGHT))
                most, truth[r["field"]] = max(most or 0.0, abs(share - truth[r["field"]])), share
        if most is None or most <= tolerance:
            break
    judged = write_stage(posteriors().select("pattern", "p"), "posteriors")
    patterns.drop()
    return join_unique(known, judged.df, "pattern").drop("pattern"), rates, judged


def surviving_values(judged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per entity and field the surviving value, from facts with posteriors: of the usable values
    judged true (if none is, of all usable ones) the most complete, then the most probable,
    then the most recent. A column per field (t, measure, p, ...), and the number of values
    judged true."""
    best = F.max(F.struct((F.col("p") >= threshold).cast("int").alias("t"), F.col("measure"), F.round("p", 9).alias("p"), F.size("yes"), F.col("at"), F.col("value").alias("value")))
    pick = lambda name: F.max(F.when(F.col("field") == name, F.col("b"))).alias(name)
    per = judged.where("ok").groupBy("entity_id", "field").agg(best.alias("b"), F.count(F.when(F.col("p") >= threshold, 1)).alias("k"))
    return per.groupBy("entity_id").agg(F.sum("k").alias("n_values"), *(pick(x) for x in FIELDS))


def whole_survivors(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """(entity_id, record_id) of the entities where one record alone has the surviving
    description's length, the surviving confidence and the surviving count all at once."""
    mine = rows.where("real and conf_ok and n_ok").select("entity_id", "record_id", F.col("length").cast("double").alias("d"), "conf", F.col("n").cast("double").alias("n"))
    kept = wide.select("entity_id", F.col("description.measure").alias("kd"), F.col("discovery_confidence.measure").alias("kc"), F.col("evidence_count.measure").alias("kn"))
    same = join_unique(mine, kept, "entity_id").where("d = kd and conf = kc and n = kn")
    return same.groupBy("entity_id").agg(F.min("record_id").alias("record_id"), F.max("record_id").alias("last")).where("record_id = last").drop("last")


def survivors(df: DataFrame, threshold: float = 0.5, text: bool = True) -> DataFrame:
    """One row per entity: entity_id, n_values, description, discovery_confidence,
    evidence_count, label, entity_type, the probability of the first three, grouped (two or
    more records) and record_id (the record that alone has all three surviving values, or null).

    Per field the survivor is, of the usable values judged true (posterior at least
    ``threshold``; if none is, of all usable ones), the most complete one, then the most
    probable, then the most recent. Columns read: label, entity_type, description,
    discovery_confidence, evidence_count, source_type, discovered_at, record_id. A field
    without a usable value is null; without ``text`` a description stays the hash it is compared
    by. Null labels and types count as empty in the identity;
    rows with a null record_id are left out; repeated rows count once; an empty table gives
    no rows.
    """
    rows = slim(df).df
    f = facts(rows)
    judged, *used = infer_quality(f.df)
    wide = write_stage(surviving_values(judged, threshold), "survivors").df
    for stage in (f, *used):
        stage.drop()
    groups = rows.groupBy("entity_id").agg((F.min("record_id") < F.max("record_id")).alias("grouped"))
    out = groups.join(wide, "entity_id", "left").join(whole_survivors(rows, wide), "entity_id", "left").select(
        "entity_id", "n_values", F.col("description.value").alias("description"), F.col("discovery_confidence.measure").alias("discovery_confidence"), F.col("evidence_count.measure").cast("int").alias("evidence_count"),
        F.col("label.value").alias("label"), F.col("entity_type.value").alias("entity_type"), F.round("description.p", 6).alias("p_description"), F.round("discovery_confidence.p", 6).alias("p_confidence"), F.round("evidence_count.p", 6).alias("p_evidence"),
        "grouped", "record_id",
    )
    return with_text(out, df, "description") if text else out


def values_judged_true(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(entity_id, field, value, probability): every value of every field judged true."""
    judged, rates, _ = infer_quality(facts(slim(df).df).df)
    rates.drop()
    true = judged.where("ok").select("entity_id", "field", "value", F.round("p", 6).alias("probability")).where(F.col("probability") >= threshold)
    return with_text(true.where("field = 'description'"), df, "value").unionByName(true.where("field <> 'description'")).select("entity_id", "field", "value", "probability")


def source_quality(df: DataFrame) -> DataFrame:
    """(field, source, sensitivity, specificity) as inferred."""
    rows = slim(df)
    f = facts(rows.df)
    _, rates, judged = infer_quality(f.df)
    for stage in (rows, f, judged):
        stage.drop()
    field, cut = F.substring_index("k", "|", 1), F.locate("|", F.col("k"))
    return rates.df.where(cut > 0).select(field.alias("field"), F.expr("substring(k, locate('|', k) + 1)").alias("source"), F.round("sens", 6).alias("sensitivity"), F.round(1 - F.col("fpr"), 6).alias("specificity"))
