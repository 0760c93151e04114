"""Linking entities to laws, question answering over the graph, carried headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataweave.operators.extraction import spans

# Citation patterns in order of precedence; types governed by law.
CITATIONS = (
    ("section_clause_law", r"(?i)§\s*(\d+[\w]*)\s+Abs\.?\s*(\d+[\w]*)\s+([A-Z][A-Za-z]+)"),
    ("section_clause", r"(?i)§\s*(\d+[\w]*)\s+Absatz\s+(\d+[\w]*)"),
    ("section_law", r"(?i)§\s*(\d+[\w]*)\s+([A-Z][A-Za-z]+)"),
    ("article_law", r"(?i)Art\.?\s*(\d+[\w]*)\s+([A-Z][A-Za-z]+)"),
    ("name", r"(?i)\b(Strahlenschutzgesetz|Atomgesetz|Berggesetz|Immissionsschutzgesetz|Kreislaufwirtschaftsgesetz)\b"),
    ("abbreviation", r"(?i)\b(AtG|BBergG|BImSchG|KrWG|StrlSchG|StrSchG|StrVG|AtVfV|UVPG|StrlSchV)\b"),
)
LAW_CODES = {
    "atg": "AtG", "atomgesetz": "AtG", "bbergg": "BBergG", "berggesetz": "BBergG", "bimschg": "BImSchG", "immissionsschutzgesetz": "BImSchG", "krwg": "KrWG", "kreislaufwirtschaftsgesetz": "KrWG",
    "strlschg": "StrlSchG", "strschg": "StrlSchG", "strahlenschutzgesetz": "StrlSchG", "strlschv": "StrlSchV", "uvpg": "UVPG", "atvfv": "AtVfV", "vwvfg": "VwVfG", "vwgo": "VwGO", "bgb": "BGB", "stpo": "StPO", "owig": "OWiG",
}
GOVERNED = ("Facility", "Organization", "Process", "Activity", "Permit", "SafetySystem", "Regulation", "Operation", "Action", "DomainRequirement", "DomainPredicate", "PlanningDomain", "State")
#: Keyword rules (number, pattern over the lower-case label, law, section, confidence).
EXAMPLE_RULES = ((1, "strahlenschutz|dosi", "StrlSchG", None, 0.8), (2, "abfall|waste", "AtG", "9a", 0.75), (3, "genehmigung|licence|permit", "AtG", "7", 0.7))


def explicit_citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, law_code, section, confidence, start_char): citations of known laws at .95; a
    clause without a law counts as AtG at .7; other laws are left out."""
    s = spans(df, key, text, list(CITATIONS))
    pats = {n: p for n, p in CITATIONS}
    code = F.create_map(*[F.lit(x) for kv in LAW_CODES.items() for x in kv])
    g = lambda n, i: F.regexp_extract("match", "(?u)" + pats[n], i)
    law = F.when(F.col("name") == "section_clause_law", g("section_clause_law", 3)).when(F.col("name") == "section_law", g("section_law", 2)).when(F.col("name") == "article_law", g("article_law", 2)).when(F.col("name").isin("name", "abbreviation"), F.col("match"))
    sec = (
        F.when(F.col("name") == "section_clause_law", F.concat(g("section_clause_law", 1), F.lit(" Abs. "), g("section_clause_law", 2)))
        .when(F.col("name") == "section_clause", F.concat(g("section_clause", 1), F.lit(" Abs. "), g("section_clause", 2)))
        .when(F.col("name") == "section_law", g("section_law", 1))
        .when(F.col("name") == "article_law", F.concat(F.lit("Art. "), g("article_law", 1)))
    )
    x = s.withColumn("law_code", F.when(F.col("name") == "section_clause", F.lit("AtG")).otherwise(code[F.lower(law)])).withColumn("section", sec)
    return x.where("law_code is not null").select(key, "law_code", "section", F.when(F.col("name") == "section_clause", 0.7).otherwise(0.95).alias("confidence"), "start_char")


def keyword_links(df: DataFrame, rules, key: str, label: str) -> DataFrame:
    """(key, law, section, confidence): rules whose pattern is in the label, the first rule of
    each (law, section). The rules are literals of the plan, so this is one narrow pass."""
    hits = F.array_compact(F.array(*(F.when(F.lower(label).rlike("(?u)" + p), F.struct(F.lit(n).alias("no"), F.lit(law).alias("law"), F.lit(sec).cast("string").alias("section"), F.lit(c).alias("confidence"))) for n, p, law, sec, c in rules)))
    x = df.where(F.col(label).isNotNull()).select(key, F.explode(hits).alias("h")).groupBy(key, "h.law", "h.section").agg(F.min(F.struct("h.no", "h.confidence")).alias("b"))
    return x.select(key, "law", "section", F.col("b.confidence").alias("confidence"))


def type_defaults(nodes: DataFrame, linked: DataFrame, defaults: DataFrame) -> DataFrame:
    """Default links of the types of nodes that nothing else linked."""
    return nodes.join(linked, "id", "left_anti").join(F.broadcast(defaults), "node_type").select("id", "law", "section", "confidence")


def relationship_type(kind: Column, context: Column) -> Column:
    c = F.lower(context)
    return F.when(kind.isin(*GOVERNED), "GOVERNED_BY").when(c.contains("definition") | c.contains("defined"), "DEFINED_IN").when(c.contains("permit") | c.contains("approval"), "REQUIRES").otherwise("GOVERNED_BY")


def cascade(explicit: DataFrame, keyword: DataFrame, defaults: DataFrame) -> DataFrame:
    """Links of the three sources (id, law, section, confidence): keyword links without the
    explicit (id, law, section), defaults only for nodes without either; each with its reason."""
    tag = lambda d, r: d.select("id", "law", "section", "confidence", F.lit(r).alias("reason"))
    same = [keyword["id"].eqNullSafe(explicit["id"]), keyword["law"].eqNullSafe(explicit["law"]), keyword["section"].eqNullSafe(explicit["section"])]
    k = keyword.join(explicit, same, "left_anti")
    first = tag(explicit, "explicit").unionByName(tag(k, "keyword"))
    return first.unionByName(tag(defaults.join(first.select("id").distinct(), "id", "left_anti"), "default"))


def resolve_paragraphs(links: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Links with target: the paragraph LAW_S_n where it exists, else the law."""
    p = paragraphs.select("pid").distinct()
    x = links.withColumn("pid", F.concat("law", F.lit("_S_"), "section"))
    return x.join(p.withColumn("__there", F.lit(True)), "pid", "left").withColumn("target", F.when(F.col("__there"), F.col("pid")).otherwise(F.col("law"))).drop("pid", "__there")


def carried_headings(parts: DataFrame, first: str = "General") -> DataFrame:
    """(law, pos, section): the last heading at or before each part of a law."""
    w = W.partitionBy("law").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)  # the parts of one law
    return parts.select("law", "pos", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit(first)).alias("section"))


def entity_query(nodes: DataFrame, question: str, k: int = 10) -> DataFrame:
    """Ids whose label contains a word of the question (over three letters) or is contained in one."""
    words = [w for w in question.lower().split() if len(w) > 3]
    q = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    hit = F.exists(q, lambda w: F.contains(F.lower("label"), w) | (F.contains(w, F.lower("label")) & (F.length("label") > 0)))
    return nodes.where(hit).select("id").orderBy("id").limit(k)


def relation_query(edges: DataFrame, question: str, k: int = 10) -> DataFrame:
    """Ids of edges with a part of their type in the question."""
    return edges.where(F.exists(F.split(F.lower("edge_type"), "_"), lambda p: F.contains(F.lit(question.lower()), p))).select("id").orderBy("id").limit(k)


def prefix_split(df: DataFrame, order: str, share: float) -> DataFrame:
    """(order, train): the first int(n * share) rows in order are for training.

    The place of the cut comes from an exact percentile of the unique order column, not
    from a sort in one task."""
    n = df.count()
    k = int(n * share)
    if k == 0:
        return df.select(order, F.lit(False).alias("train"))
    cut = df.agg(F.percentile(order, (k - 1) / max(1, n - 1)).alias("cut"))
    return df.crossJoin(F.broadcast(cut)).select(order, (F.col(order) <= F.col("cut") + 1e-9).alias("train"))
