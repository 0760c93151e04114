"""Readers for documents, laws, questions, gold data and ontologies; checkpoints and versions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File types by suffix.
SUFFIXES = {"txt": "txt", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "xml": "xml", "pdf": "pdf", "docx": "docx", "pptx": "pptx"}
TEXT_TYPES = ("txt", "markdown", "html", "xml")
OFFICE_TYPES = ("docx", "pptx")
GOLD = "id string, start int, end int, text string, label string"


def office_text(kind: str, raw: bytes) -> str:
    """Text of an Office Open XML file: the paragraphs of a document that have text (those in tables
    left out), or the texts of the shapes of a presentation in slide order, with blank lines
    between. A paragraph's runs are joined, line breaks kept."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    name = lambda e: e.tag.rpartition("}")[2]

    def written(e) -> str:
        return "".join(t.text or "" if name(t) == "t" else "\t" if name(t) == "tab" else "\n" if name(t) == "br" else "" for t in e.iter())

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if kind == "docx":
            body = next(e for e in ET.fromstring(z.read("word/document.xml")) if name(e) == "body")
            blocks = [written(p) for p in body if name(p) == "p"]
        else:
            slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
            shapes = (b for n in slides for b in ET.fromstring(z.read(n)).iter() if name(b) == "txBody")
            blocks = ["\n".join(written(p) for p in b if name(p) == "p") for b in shapes]
    return "\n\n".join(x.strip() for x in blocks if x.strip())


def load_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, file_type, content, error): files by their lower-case suffix. Text types are
    decoded; html loses its markup; office files give their paragraphs or shape texts; types
    without a reader, unknown suffixes and broken files have a null content and an error, so a
    batch goes on."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[suffix]
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", kind.alias("file_type"), "content")
    text = F.col("content").cast("string")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style).*?</\1>", " "), r"(?s)<[^>]+>", " "), r"\s+", " "))
    known = F.coalesce(F.col("file_type").isin(*OFFICE_TYPES), F.lit(False))
    plain = d.where(~known).select("path", "file_type", F.when(F.col("file_type") == "html", bare).when(F.col("file_type").isin(*TEXT_TYPES), text).alias("content"), F.when(F.col("file_type").isNull(), "unknown suffix").when(~F.col("file_type").isin(*TEXT_TYPES), "no reader").alias("error"))

    def unpack(batches):
        for x in batches:
            rows = []
            for p, k, raw in zip(x["path"], x["file_type"], x["content"]):
                try:
                    rows.append((p, k, office_text(k, bytes(raw)), None))
                except Exception as e:  # a broken file must not end the batch
                    rows.append((p, k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "file_type", "content", "error"])

    return plain.unionByName(d.where(known).mapInPandas(unpack, "path string, file_type string, content string, error string"))


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, enbez, title, text, norm_type) of German law XML: one row per norm in file
    order, classified as METADATA, STRUCTURE, APPENDIX or PARAGRAPH. Mixed content keeps
    its order, which the built-in XML reader loses."""

    def parse(batches):
        import xml.etree.ElementTree as ET

        for x in batches:
            rows = []
            for p, raw in zip(x["path"], x["content"]):
                try:
                    root = ET.fromstring(bytes(raw))
                except ET.ParseError:
                    continue
                for i, n in enumerate(root.iter("norm")):
                    get = lambda tag: " ".join("".join(e.itertext()).strip() for e in n.iter(tag)) or None  # noqa: B023, E731
                    enbez, title = get("enbez"), get("titel")
                    text = " ".join(re.sub(r"\s+", " ", "".join(e.itertext())).strip() for e in n.iter("Content")) or None
                    low = (enbez or "").lower()
                    kind = "METADATA" if i == 0 else "STRUCTURE" if n.find(".//gliederungseinheit") is not None and not enbez else "APPENDIX" if low.startswith(("anlage", "anhang")) else "PARAGRAPH" if enbez else "STRUCTURE"
                    rows.append((p, i, enbez, title or get("gliederungstitel"), text, kind))
            yield pd.DataFrame(rows, columns=["path", "pos", "enbez", "title", "text", "norm_type"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "BJNR*.xml").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, pos int, enbez string, title string, text string, norm_type string")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON or CSV (answers and tags separated by bars); rows without an id are left out."""
    if path.endswith(".csv"):
        d = spark.read.csv(path, header=True)
        d = d.withColumn("expected_answers", F.split("expected_answers", r"\|")).withColumn("tags", F.split("tags", r"\|")).withColumn("difficulty", F.col("difficulty").try_cast("int"))
    else:
        d = spark.read.json(path, multiLine=True)
    return d.where(F.length(F.col("id").cast("string")) > 0)


def write_questions(df: DataFrame, path: str) -> None:
    df.withColumn("expected_answers", F.concat_ws("|", "expected_answers")).withColumn("tags", F.concat_ws("|", "tags")).write.csv(path, header=True)


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of gold documents in JSON."""
    d = spark.read.schema(f"doc_id string, text string, entities array<struct<{GOLD.replace(' ', ':').replace(',:', ',')}>>, relations array<struct<subject_id:string,predicate:string,object_id:string>>").json(path, multiLine=True)
    return d.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*"), d.select("doc_id", F.explode("relations").alias("r")).select("doc_id", "r.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph stored as one JSON object."""
    d = spark.read.schema("nodes array<struct<id:string,label:string,type:string,properties:map<string,string>>>, edges array<struct<id:string,source_id:string,target_id:string,type:string,properties:map<string,string>>>").json(path, multiLine=True)
    n = d.select(F.explode("nodes").alias("n")).select("n.id", F.col("n.type").alias("node_type"), "n.label", F.col("n.properties").alias("props"))
    e = d.select(F.explode("edges").alias("e")).select("e.id", "e.source_id", "e.target_id", F.col("e.type").alias("edge_type"), F.col("e.properties").alias("props"))
    return n, e


def read_turtle_classes(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(classes (class, parent), relations (path, domain, range)) of a small ontology in Turtle;
    the subset of statements with ``a owl:Class`` or ``a owl:ObjectProperty``."""
    local = lambda s: re.split(r"[#/:]", s.strip("<>"))[-1]
    classes, rels = [], []
    for st in re.split(r"\.\s*(?:\n|$)", re.sub(r"(?m)^\s*(#|@prefix).*$", "", text)):
        m = re.match(r"\s*(\S+)\s+a\s+(owl:\w+)", st)
        if not m:
            continue
        get = lambda p: (x := re.search(rf"{p}\s+(\S+)", st)) and local(x[1].rstrip(";,"))  # noqa: B023, E731
        if m[2] == "owl:Class":
            classes.append((local(m[1]), get("rdfs:subClassOf")))
        elif m[2] == "owl:ObjectProperty":
            rels.append((local(m[1]), get("rdfs:domain"), get("rdfs:range")))
    return spark.createDataFrame(classes, "class string, parent string"), spark.createDataFrame(rels, "path string, domain string, range string")


def save_version(nodes: DataFrame, edges: DataFrame, path: str, version: str) -> None:
    """A snapshot as one partition of the versioned tables; writing it again replaces it."""
    for d, name in ((nodes, "nodes"), (edges, "edges")):
        d.write.mode("overwrite").parquet(f"{path}/{name}/version_id={version}")


def load_version(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}/version_id={version}") for n in ("nodes", "edges"))  # type: ignore[return-value]


def delete_version(spark: SparkSession, path: str, version: str) -> None:
    for n in ("nodes", "edges"):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/version_id={version}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save_checkpoint(entities: DataFrame, relations: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")
