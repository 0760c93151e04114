"""Rule-based extraction of entities, relations and references from text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default entity patterns (type, pattern, confidence), in order.
ENTITY_PATTERNS = (
    ("Facility", r"(?i)(?:Kernkraftwerk|Nuclear\s+Power\s+Plant|NPP|Nuklearkraftwerk|KKW)\s+\w+", 0.95),
    ("Facility", r"(?i)(?:nuclear|atomic)\s+(?:facility|plant|reactor|power\s+plant)", 0.85),
    ("SafetyDocument", r"(?i)(?:Sicherheitsbericht|Safety\s+(?:Report|Assessment|Document|Analysis))", 0.95),
    ("SafetyDocument", r"(?i)(?:security|safety)\s+(?:assessment|evaluation|review|inspection)", 0.85),
    ("Operation", r"(?i)(?:Betrieb|Operation|Power\s+Generation|Stromerzeugung)", 0.90),
    ("Requirement", r"(?i)(?:Sicherheitsanforderung|Safety\s+(?:Requirement|Standard|Specification))", 0.90),
)
# Default relation patterns (type, text between, source type, target type).
RELATION_PATTERNS = (
    ("locatedIn", r"(?i)\s+(?:in|bei|am\s+Standort)\s+", "Facility", "Location"),
    ("targetComponent", r"(?i)\s+(?:an|von|des|der)\s+", "Activity", "Component"),
)
# German legal patterns.
REFERENCE = r"§§?\s*\d+[a-z]?(?:\s*(?:bis|und|,)\s*§?\s*\d+[a-z]?)*(?:\s+(?:Abs(?:atz)?\.?\s*\d+))?(?:\s+(?:Satz|S\.)\s*\d+)?(?:\s+(?:Nr\.?\s*\d+))?"
AUTHORITY = r"(?:Bundesamt|Bundesministerium|Landesamt|Landesministerium|Behörde|Aufsichtsbehörde|Genehmigungsbehörde|zuständige Behörde)(?:\s+für\s+[A-Za-zÄÖÜäöüß\s,]+?)?(?=[\s,;.\)])"
DEFINITION = r"[Ii]m\s+[Ss]inne\s+(?:dieses|des)\s+(?:Gesetzes|Absatzes|Paragraphen)|[Bb]egriff(?:sbestimmung(?:en)?)|[Aa]ls\s+\w+\s+(?:gilt|gelten)|[Ii]st\s+(?:eine?|der|die|das)\s+\w+,\s+(?:die|der|das)"
PROHIBITION = r"\b(?:darf\s+nicht|dürfen\s+nicht|ist\s+(?:untersagt|verboten|unzulässig)|sind\s+(?:untersagt|verboten|unzulässig)|nicht\s+(?:gestattet|zulässig))"
OBLIGATION = r"\b(?:ist\s+verpflichtet|hat\s+[\w\s]+zu\s+\w+en|muss|müssen|sind\s+verpflichtet|hat\s+sicherzustellen|ist\s+(?:zu\s+)?\w+en\b)"
PERMISSION = r"\b(?:darf|dürfen|kann|können|ist\s+berechtigt|wird\s+(?:genehmigt|erlaubt|gestattet|zugelassen))"
AUTHORITIES = ("BfS", "BASE", "BMU", "BMUV", "BfE", "BAM", "UBA", "BfR")
LAWS = ("AtG", "StrlSchG", "StrlSchV", "BImSchG", "BImSchV", "KrWG", "WHG", "BNatSchG", "UVPG", "BBergG", "GenTG", "ChemG", "BGB", "VwVfG", "VwGO", "GG", "StGB", "StPO", "ZPO", "EnWG", "EEG", "WindSeeG", "StandAG", "EndlSiAnfV", "EndlSiUntV")
MIN_AUTHORITY = 7


def spans(df: DataFrame, key: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(key, pattern_no, name, start_char, end_char, match): all matches of regular
    expressions with their offsets, which no built-in function gives; one Arrow pass over
    whole texts. Null texts give none."""
    compiled = [(n, re.compile(p)) for n, p in patterns]
    t = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(k, i, n, m.start(), m.end(), m.group()) for k, s in zip(x[key], x[text]) if s for i, (n, c) in enumerate(compiled) for m in c.finditer(s)]
            yield pd.DataFrame(rows, columns=[key, "pattern_no", "name", "start_char", "end_char", "match"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {t}, pattern_no int, name string, start_char int, end_char int, match string")


def rule_entities(df: DataFrame, key: str, text: str, patterns=ENTITY_PATTERNS, classes: list[str] | None = None) -> DataFrame:
    """First match per (document, lower-case text, type), patterns in order; ``classes``
    restricts the types (none given: all)."""
    chosen = [p for p in patterns if not classes or p[0] in classes]
    conf = F.array(*(F.lit(p[2]) for p in chosen)) if chosen else F.array(F.lit(0.0))
    s = spans(df, key, text, [(p[0], p[1]) for p in chosen])
    g = s.groupBy(key, F.lower("match").alias("label_key"), F.col("name").alias("entity_type")).agg(F.min(F.struct("pattern_no", "start_char", "end_char", "match")).alias("b"))
    return g.select(key, F.col("b.match").alias("label"), "entity_type", F.col("b.start_char").alias("start_char"), F.col("b.end_char").alias("end_char"), conf[F.col("b.pattern_no")].alias("confidence"), F.format_string("char_%d_%d", "b.start_char", "b.end_char").alias("evidence_id"))


def rule_relations(docs: DataFrame, entities: DataFrame, key: str, text: str, patterns=RELATION_PATTERNS) -> DataFrame:
    """Ordered pairs of entities of a document whose types and text between fit a pattern.
    The pairs are joined on document and the pattern's types, not all with all."""
    p = docs.sparkSession.createDataFrame([(e, s, t, r) for e, r, s, t in patterns], "edge_type string, source_type string, target_type string, between string")
    a = entities.select(key, F.col("label").alias("source"), F.col("entity_type").alias("source_type"), F.col("end_char").alias("e1"))
    b = entities.select(key, F.col("label").alias("target"), F.col("entity_type").alias("target_type"), F.col("start_char").alias("s2"))
    j = a.join(F.broadcast(p), "source_type").join(b, [key, "target_type"]).where("s2 > e1").join(docs.select(key, text), key)
    return j.where(F.regexp_like(F.substr(text, F.col("e1") + 1, F.col("s2") - F.col("e1")), F.concat(F.lit("^(?U)"), "between", F.lit("$")))).select(key, "source", "edge_type", "target")


def locate_span(text: Column, snippet: Column) -> Column:
    """0-based start: exact, else without case, else of the first word over three letters, else -1."""
    low, first = F.lower(text), F.lower(F.split_part(snippet, F.lit(" "), F.lit(1)))
    at = lambda a, b: F.nullif(F.instr(a, b), F.lit(0))
    return F.coalesce(at(text, snippet), at(low, F.lower(snippet)), F.when(F.length(first) > 3, at(low, first)), F.lit(0)) - 1


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reference): every § citation of a text, inside the JVM."""
    return df.select(key, F.explode(F.regexp_extract_all(text, F.lit("(" + REFERENCE + ")"), F.lit(1))).alias("reference"))


def legal_entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """References, authorities (seven letters or more, or a known short name), definitions,
    and prohibitions, obligations and permissions; the last two only where they don't touch
    a prohibition. The label of a modality is its sentence."""
    named = r"\b(?:" + "|".join(AUTHORITIES) + r")\b"
    kinds = [("LegalReference", REFERENCE), ("Behoerde", AUTHORITY), ("Behoerde", named), ("Definition", DEFINITION)]
    modal = [("Prohibition", PROHIBITION, "Verbot"), ("Obligation", OBLIGATION, "Pflicht"), ("Permission", PERMISSION, "Erlaubnis")]
    c1, c2 = [(n, re.compile(p)) for n, p in kinds], [(n, re.compile(p), w) for n, p, w in modal]
    t = df.schema[key].dataType.simpleString()

    def one(s: str):
        for i, (n, c) in enumerate(c1):
            for m in c.finditer(s):
                g = m.group().strip()
                if i != 1 or len(g) >= MIN_AUTHORITY:
                    yield n, g, m.start(), m.end()
        bad = [m.span() for m in c2[0][1].finditer(s)]
        for n, c, w in c2:
            for m in c.finditer(s):
                a, e = m.span()
                if n != "Prohibition" and any(x <= a <= y or x <= e <= y for x, y in bad):
                    continue
                lo, hi = s.rfind(".", 0, a), s.find(".", e)
                yield n, f"{w}: {s[lo + 1 : hi + 1 if hi > 0 else len(s)].strip()[:80]}", a, e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(k, *r) for k, s in zip(x[key], x[text]) if s for r in one(s)]
            yield pd.DataFrame(rows, columns=[key, "entity_type", "label", "start_char", "end_char"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {t}, entity_type string, label string, start_char int, end_char int")


def legal_relations(entities: DataFrame, key: str) -> DataFrame:
    """Paragraph to references and definitions (.95), authority to obligation (.855),
    obligation to actor (.8075), within a paragraph."""
    own = {"LegalReference": "referenziert", "Definition": "definiert"}
    m = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
    a = entities.where(F.col("entity_type").isin(*own)).select(key, F.col(key).cast("string").alias("source"), m[F.col("entity_type")].alias("predicate"), F.col("label").alias("target"), F.lit(0.95).alias("confidence"))
    of = lambda kinds, name: entities.where(F.col("entity_type").isin(*kinds)).select(key, F.col("label").alias(name))
    b = of(["Behoerde"], "source").join(of(["Obligation"], "target"), key).select(key, "source", F.lit("zustaendig").alias("predicate"), "target", F.lit(0.855).alias("confidence"))
    c = of(["Obligation"], "source").join(of(["Betreiber", "LegalActor"], "target"), key).select(key, "source", F.lit("betrifft").alias("predicate"), "target", F.lit(0.8075).alias("confidence"))
    return a.unionByName(b).unionByName(c)


#: Characters of labels that one automaton is built from.
MOST_LABEL_CHARACTERS = 50_000_000


def label_mentions(docs: DataFrame, labels: DataFrame, key: str, text: str, label_id: str, label: str) -> DataFrame:
    """(key, label_id): every label that occurs in a text, case apart, in one pass over each
    text with an automaton of all labels. The labels must be a curated list: their total
    length is checked before they are sent out. Blank labels and null texts give none."""
    size = labels.agg(F.sum(F.length(label))).first()[0] or 0
    if size > MOST_LABEL_CHARACTERS:
        raise ValueError(f"labels of more than {MOST_LABEL_CHARACTERS} characters")
    rows = labels.where(F.length(F.trim(label)) > 0).select(label_id, F.lower(label).alias("l")).distinct().collect()
    by: dict[str, list] = {}
    for i, name in rows:
        by.setdefault(name, []).append(i)
    shared = docs.sparkSession.sparkContext.broadcast(by)
    kt, lt = docs.schema[key].dataType.simpleString(), labels.schema[label_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for name, ids in shared.value.items():
            a.add_word(name, ids)
        if shared.value:
            a.make_automaton()
        for x in batches:
            found = [(k, i) for k, t in zip(x[key], x[text]) if t and shared.value for i in {i for _, ids in a.iter(t.lower()) for i in ids}]
            yield pd.DataFrame(found, columns=[key, label_id])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kt}, `{label_id}` {lt}")


def align(df: DataFrame, text: str, snippet: str, threshold: float = 0.8) -> DataFrame:
    """Adds status and score: exact if the snippet is in the text, else by its longest common
    block: .99 exact, ``threshold`` fuzzy, above .5 partial, else missing with score 0."""

    @F.pandas_udf("double")
    def block(a: pd.Series, b: pd.Series) -> pd.Series:
        def share(x, y):
            if not y:
                return 0.0
            m = SequenceMatcher(None, x or "", y, autojunk=False)
            return m.find_longest_match(0, len(x or ""), 0, len(y)).size / len(y)

        return pd.Series([share(x, y) for x, y in zip(a, b)])

    found = F.contains(text, snippet) & (F.length(snippet) > 0)
    x = df.withColumn("score", F.when(found, 1.0).otherwise(block(F.col(text), F.col(snippet))))
    s = F.when(F.col("score") >= 0.99, "exact").when(F.col("score") >= threshold, "fuzzy").when(F.col("score") > 0.5, "partial").otherwise("missing")
    return x.withColumn("status", s).withColumn("score", F.when(F.col("status") == "missing", 0.0).otherwise(F.col("score")))


def aligned_confidence(conf: Column, status: Column) -> Column:
    return F.when(status.isin("exact", "fuzzy"), F.least(F.lit(1.0), conf + 0.1)).when(status == "partial", conf * 0.8).otherwise(conf * 0.5)


def repair_json(text: str) -> str | None:
    """A JSON object out of a model's answer: fences stripped, outer braces taken, missing
    closing brackets added; None if that isn't JSON either."""
    import json

    t = re.sub(r"^```(?:json)?|```$", "", text.strip(), flags=re.M).strip()
    i = t.find("{")
    if i < 0:
        return None
    t = t[i : t.rfind("}") + 1] if t.rfind("}") > i else t[i:]
    for tail in ("", '"', *("]" * a + "}" * b for a in range(3) for b in range(1, 4))):
        try:
            return json.dumps(json.loads(t + tail))
        except ValueError:
            continue
    return None


def integer_value(text: str) -> int | None:
    """The value of an integer or of a sum, difference or product of integers; never evaluated as code."""
    m = re.fullmatch(r"\s*-?\d+(\s*[-+*]\s*-?\d+)*\s*", text or "")
    if not m:
        return None
    total = 0
    for term in re.finditer(r"([-+]?)\s*(-?\d+(?:\s*\*\s*-?\d+)*)", re.sub(r"\s+", "", text)):
        v = 1
        for f in term[2].split("*"):
            v *= int(f)
        total += -v if term[1] == "-" else v
    return total


def cooccurring_pairs(mentions: DataFrame, key: str, item: str) -> DataFrame:
    """(source_id, target_id, n_docs, first_doc): items of a list that are mentioned in one document
    (mentions: key, item), each two once whichever way round. Pairs are made within a document
    of what the list has, and summed map-side."""
    m = mentions.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    a, b = m.withColumnRenamed(item, "source_id"), m.withColumnRenamed(item, "target_id")
    return a.join(b, key).where("source_id < target_id").groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min(key).alias("first_doc"))
