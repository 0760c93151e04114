"""Documents to chunks: fixed size, packed paragraphs, sections by heading, hierarchical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import token_count

# The words looked for by ``language_of`` among the first 50 tokens.
GERMAN_WORDS = ("der", "die", "und", "in", "zu", "das", "mit")


def fixed_size(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks from starts 0, size - overlap, ...; every start but the first reaches another
    overlap // 2 back, so the effective overlap is overlap + overlap // 2. Blank chunks are
    left out; empty and null texts give none. Offsets are characters."""
    step = max(1, size - overlap)
    n = F.length(text)
    x = df.where(n > 0).select(key, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("s"))
    x = x.withColumn("end_char", F.least(F.col("s") + size, F.length("__t"))).withColumn("start_char", F.when(F.col("s") > 0, F.greatest(F.lit(0), F.col("s") - overlap // 2)).otherwise(0))
    x = x.withColumn("content", F.substr("__t", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")))
    return x.where(token_count("content") > 0).select(key, "start_char", "end_char", "content", token_count("content").alias("token_count"))


def packed_paragraphs(df: DataFrame, key: str, text: str, limit: int = 1000) -> DataFrame:
    """Paragraphs (blank-line blocks) packed while their lengths stay within ``limit``;
    separators don't count; a longer paragraph is a chunk by itself. The fold over a
    text's paragraphs runs inside the JVM, a text at a time."""
    para = F.split(text, "\n\n", -1)
    start = F.struct(F.array().cast("array<struct<c:string,s:int>>").alias("done"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        flush = acc["buf"].isNotNull() & (acc["size"] + F.length(p) > limit)
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(F.struct(acc["buf"].alias("c"), acc["at"].alias("s"))))).otherwise(acc["done"]).alias("done"),
            F.when(flush | acc["buf"].isNull(), p).otherwise(F.concat(acc["buf"], F.lit("\n\n"), p)).alias("buf"),
            F.when(flush, F.length(p)).otherwise(acc["size"] + F.length(p)).alias("size"),
            F.when(flush, acc["at"] + F.length(acc["buf"]) + 2).otherwise(acc["at"]).alias("at"),
        )

    done = F.aggregate(para, start, step, lambda a: F.concat(a["done"], F.array(F.struct(a["buf"].alias("c"), a["at"].alias("s")))))
    x = df.where(F.col(text).isNotNull()).select(key, F.posexplode(done).alias("chunk_no", "x"))
    return x.select(key, "chunk_no", F.col("x.s").alias("start_char"), (F.col("x.s") + F.length("x.c")).alias("end_char"), F.col("x.c").alias("content"), token_count("x.c").alias("token_count"))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """One chunk per markdown heading (levels 1-6) with its lines; lines before the first
    heading are a section with a null heading and level 0. ``section_index`` is the line
    number of the next heading, null for the last section. Runs text by text."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.array().cast("array<struct<h:string,l:int,s:int,c:string,n:int>>").alias("done"), F.lit(None).cast("string").alias("h"), F.lit(0).alias("l"), F.lit(0).alias("s"), F.lit(None).cast("string").alias("c"), F.lit(0).alias("at"), F.lit(0).alias("i"))
    head = r"^(#{1,6})\s+(.+)$"

    def step(a: Column, line: Column) -> Column:
        is_head = line.rlike(head)
        out = F.concat(a["done"], F.array(F.struct(a["h"].alias("h"), a["l"].alias("l"), a["s"].alias("s"), a["c"].alias("c"), a["i"].alias("n"))))
        return F.struct(
            F.when(is_head & a["c"].isNotNull(), out).otherwise(a["done"]).alias("done"),
            F.when(is_head, F.regexp_extract(line, head, 2)).otherwise(a["h"]).alias("h"),
            F.when(is_head, F.length(F.regexp_extract(line, head, 1))).otherwise(a["l"]).alias("l"),
            F.when(is_head, a["at"]).otherwise(a["s"]).alias("s"),
            F.when(is_head | a["c"].isNull(), line).otherwise(F.concat(a["c"], F.lit("\n"), line)).alias("c"),
            (a["at"] + F.length(line) + 1).alias("at"),
            (a["i"] + 1).alias("i"),
        )

    last = lambda a: F.concat(a["done"], F.array(F.struct(a["h"].alias("h"), a["l"].alias("l"), a["s"].alias("s"), a["c"].alias("c"), F.lit(None).cast("int").alias("n"))))
    x = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.aggregate(lines, start, step, last)).alias("section_no", "x"))
    return x.select(key, "section_no", F.col("x.h").alias("heading"), F.col("x.l").alias("level"), F.col("x.s").alias("start_char"), (F.col("x.s") + F.length("x.c")).alias("end_char"), F.col("x.n").alias("section_index"), F.col("x.c").alias("content"))


def hierarchical(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50, least: int = 50) -> DataFrame:
    """Sections as parents with fixed-size children; children under ``least`` characters are dropped."""
    parents = sections(df, key, text).withColumn("chunk_id", F.sha2(F.concat_ws("/", F.col(key).cast("string"), "section_no"), 256))
    kids = fixed_size(parents.select(F.col("chunk_id").alias("parent"), "content"), "parent", "content", size, overlap).where(F.length(F.trim("content")) >= least)
    top = parents.select("chunk_id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hierarchy_level"), "start_char", "end_char", "content")
    low = kids.select(F.sha2(F.concat_ws("/", "parent", F.col("start_char").cast("string")), 256).alias("chunk_id"), "parent", F.lit(1).alias("hierarchy_level"), "start_char", "end_char", F.trim("content").alias("content"))
    return top.unionByName(low)


def language_of(text: Column) -> Column:
    """``auto`` under 20 characters; ``de`` if more than 5 of 7 German words are among the
    first 50 tokens; else ``en``."""
    first = F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""), 1, 50)
    hits = F.size(F.array_intersect(first, F.array(*map(F.lit, GERMAN_WORDS))))
    return F.when(text.isNull() | (F.length(text) < 20), "auto").when(hits > 5, "de").otherwise("en")


def ingestion_statistics(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").cast("long").alias("n_tokens"), F.max(F.col("end_char") - F.col("start_char")).cast("long").alias("longest"))
