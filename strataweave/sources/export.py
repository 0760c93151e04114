"""Graph exports and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a description that GraphML keeps.
GRAPHML_DESCRIPTION = 500


def safe_label(c: Column) -> Column:
    """Blank, - and / become _; a leading digit is prefixed by _."""
    x = F.translate(c, " -/", "___")
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("_"), x)).otherwise(x)


def iri(c: Column) -> Column:
    """``:id`` for a safe id, else a percent-encoded IRI."""
    enc = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return F.when(c.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit(":"), c)).otherwise(F.concat(F.lit("<http://example.org/kg/"), enc, F.lit(">")))


def quoted(c: Column) -> Column:
    x = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), x, F.lit('"'))


def to_turtle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): one line per triple of types, labels and edges; null values give none."""
    a = nodes.where("node_type is not null").select(F.concat(iri(F.col("id")), F.lit(" a :"), safe_label(F.col("node_type")), F.lit(" .")).alias("line"))
    b = nodes.where("label is not null").select(F.concat(iri(F.col("id")), F.lit(" rdfs:label "), quoted(F.col("label")), F.lit(" .")).alias("line"))
    c = edges.select(F.concat(iri(F.col("source_id")), F.lit(" :"), safe_label(F.col("edge_type")), F.lit(" "), iri(F.col("target_id")), F.lit(" .")).alias("line"))
    return a.unionByName(b).unionByName(c)


def to_json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): every node and edge as one JSON object."""
    j = lambda d, k: d.select(F.lit(k).alias("kind"), F.to_json(F.struct(*d.columns)).alias("json"))
    return j(nodes, "node").unionByName(j(edges, "edge"))


def to_jsonld(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, json): node objects with their outgoing edges by type.

    The targets of one (node, type) are one JSON array by the format; edges are counted out
    per node before, and nodes without edges are kept."""
    per = edges.groupBy(F.col("source_id").alias("id"), "edge_type").agg(F.array_sort(F.collect_set("target_id")).alias("to"))
    out = per.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "to")))).alias("edges"))
    return nodes.join(out, "id", "left").select("id", F.to_json(F.struct(F.col("id").alias("@id"), F.col("node_type").alias("@type"), "label", "edges")).alias("json"))


def to_cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(no, statement): nodes, an index per label, edges, to be run in the order of ``no``."""
    n = nodes.select(F.lit(1).alias("no"), F.concat(F.lit("CREATE (:"), safe_label(F.col("node_type")), F.lit(" {id: "), quoted(F.col("id")), F.lit(", label: "), quoted(F.coalesce("label", F.lit(""))), F.lit("});")).alias("statement"))
    i = nodes.select(safe_label(F.col("node_type")).alias("t")).distinct().select(F.lit(2).alias("no"), F.concat(F.lit("CREATE INDEX FOR (n:"), "t", F.lit(") ON (n.id);")).alias("statement"))
    e = edges.select(F.lit(3).alias("no"), F.concat(F.lit("MATCH (a {id: "), quoted(F.col("source_id")), F.lit("}), (b {id: "), quoted(F.col("target_id")), F.lit("}) CREATE (a)-[:"), safe_label(F.col("edge_type")), F.lit("]->(b);")).alias("statement"))
    return n.unionByName(i).unionByName(e)


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def to_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(no, line): elements of a GraphML file; head and foot are added on writing."""
    n = nodes.select(F.lit(1).alias("no"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="label">'), _xml(F.substring(F.coalesce("label", F.lit("")), 1, GRAPHML_DESCRIPTION)), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("no"), F.concat(F.lit('<edge source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('"><data key="type">'), _xml(F.col("edge_type")), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


FORMATS = {"json": to_json_lines, "jsonld": to_jsonld, "turtle": to_turtle, "ttl": to_turtle, "rdf": to_turtle, "cypher": to_cypher, "graphml": to_graphml}


def export(nodes: DataFrame, edges: DataFrame, form: str, path: str) -> None:
    """Write one of FORMATS as text files; an unknown format is an error."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    d = FORMATS[form](nodes, edges)
    if "no" in d.columns:
        d = d.orderBy("no")
    d.select(d.columns[-1]).write.text(path)


def content_hash(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, content_hash): SHA-256 of the JSON list of the sorted distinct keys.

    The hash is defined over one string per group; groups are versions, and the string is
    built from distinct keys only."""
    ids = df.select(group, key).distinct().groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("k"))
    text = F.concat(F.lit("["), F.array_join(F.transform("k", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    return ids.select(group, F.sha2(text, 256).alias("content_hash"))


def findings_yaml(findings: DataFrame) -> DataFrame:
    """(id, yaml): one YAML list item per finding (id, label, entity_type, confidence, n_evidence,
    first_evidence, relations as map<string,array<string>>); head and order are added on
    writing. A null evidence or an empty map leaves its lines out."""
    line = lambda name, c: F.concat(F.lit(f"    {name}: "), c)
    pairs = F.transform(F.array_sort(F.map_entries("relations")), lambda e: F.concat(F.lit("      "), e["key"], F.lit(": ["), F.array_join(e["value"], ", "), F.lit("]")))
    rel = F.when(F.size("relations") > 0, F.concat(F.lit("    relations:\n"), F.array_join(pairs, "\n")))
    ev = F.when(F.col("first_evidence").isNotNull(), F.concat(F.lit('    first_evidence: "'), F.translate(F.substring("first_evidence", 1, 100), "\n", " "), F.lit('..."')))
    parts = [F.concat(F.lit("  - id: "), "id"), line("label", F.col("label")), line("type", F.col("entity_type")), line("confidence", F.format_string("%.2f", "confidence")), rel, F.when(F.col("n_evidence") > 0, line("evidence_count", F.col("n_evidence").cast("string"))), ev]
    return findings.select("id", F.concat_ws("\n", *parts).alias("yaml"))


def markdown_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result (at most ``most`` rows, else an error) as a Markdown section: a title and a
    table in the order of its rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([f"## {title}", "", *head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])
