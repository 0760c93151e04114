"""Merging of rule and model extractions, discovery results, and vector-based resolution."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import norm
from strataweave.operators.structural import components
from strataweave.plans.lineage import materialize

# Weights of rules and model, bonus of agreement, least confidence kept.
RULES, MODEL, AGREEMENT, KEPT = 0.7, 0.5, 0.15, 0.4


def legal_entities(rules: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, label, entity_type, confidence): each rule entity takes the most similar unused
    model entity of its type (ratio above .8, or equal) for (.7 r + .5 l) / 2 + .15, at most 1;
    the rest are weighted; those under .4 are dropped. Greedy within a paragraph, whose
    entities are few."""
    cols = [key, "label", "entity_type", "confidence"]
    both = rules.select(*cols, F.lit(1).alias("rule")).unionByName(model.select(*cols, F.lit(0).alias("rule")))
    t = rules.schema[key].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["entity_type", "label", "confidence"])
        r, m = p[p["rule"] == 1].to_dict("records"), p[p["rule"] == 0].to_dict("records")
        used, out = set(), []
        for a in r:
            best, at = 0.8, -1
            for i, b in enumerate(m):
                if i not in used and a["entity_type"] == b["entity_type"]:
                    s = 1.0 if a["label"].lower() == b["label"].lower() else SequenceMatcher(None, a["label"].lower(), b["label"].lower()).ratio()
                    if s > best:
                        best, at = s, i
            c = RULES * a["confidence"]
            if at >= 0:
                used.add(at)
                c = min(1.0, (c + MODEL * m[at]["confidence"]) / 2 + AGREEMENT)
            out.append((a[key], a["label"], a["entity_type"], c))
        out += [(b[key], b["label"], b["entity_type"], MODEL * b["confidence"]) for i, b in enumerate(m) if i not in used]
        return pd.DataFrame([o for o in out if o[3] >= KEPT], columns=cols)

    return both.groupBy(key).applyInPandas(run, f"`{key}` {t}, label string, entity_type string, confidence double")


def legal_relations(rules: DataFrame, model: DataFrame, strict_compat: bool = False) -> DataFrame:
    """(source, predicate, target, confidence). ``strict_compat``: the two sides are only weighted
    and united; else equal relations merge as entities do."""
    on = ["source", "predicate", "target"]
    r = rules.groupBy(*on).agg(F.max("confidence").alias("r"))
    m = model.groupBy(*on).agg(F.max("confidence").alias("m"))
    if strict_compat:
        x = r.select(*on, (RULES * F.col("r")).alias("confidence")).unionByName(m.select(*on, (MODEL * F.col("m")).alias("confidence")))
    else:
        merged = F.least(F.lit(1.0), (RULES * F.col("r") + MODEL * F.col("m")) / 2 + AGREEMENT)
        x = r.join(m, on, "full_outer").select(*on, F.when(F.col("r").isNotNull() & F.col("m").isNotNull(), merged).otherwise(F.coalesce(RULES * F.col("r"), MODEL * F.col("m"))).alias("confidence"))
    return x.where(F.col("confidence") >= KEPT)


def discovery_merge(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, evidence) of findings (ord, label, entity_type, confidence, source_id): the first
    of the most confident finding of a key (label and type without case and outer blanks), and
    the key's evidence, once per source."""
    k = found.withColumn("label_key", norm("label")).withColumn("type_key", norm("entity_type"))
    best = k.groupBy("label_key", "type_key").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "ord", "label", "entity_type", "confidence")).alias("b"), F.count(F.lit(1)).alias("n"))
    ev = k.groupBy("label_key", "type_key", "source_id").agg(F.min("ord").alias("ord"))
    return best.select("label_key", "type_key", "b.label", "b.entity_type", "b.confidence", "n"), ev


#: Least and greatest number of rows of a block of the exact comparison; a task holds two blocks
#: and the products of a tile. A row is shuffled once for each block, so many rows need few blocks.
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCKS = 8192, 131_072, 8


#: By how much a cosine in single precision may be too small.
SLACK = 1e-4


def block_pairs(df: DataFrame, key: str, rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Rows with (bi, bj, left): every two blocks of rows meet in one group, each with itself too.
    A row is in as many groups as there are blocks, so the comparison is exact and its work
    quadratic; no pairs are made but those a task keeps."""
    n = max(1, -(-df.count() // rows))
    at = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    all_ = F.sequence(F.lit(0), F.lit(n - 1))
    left = at.withColumn("__o", F.explode(F.filter(all_, lambda o: o >= F.col("__b")))).withColumns({"bi": F.col("__b"), "bj": F.col("__o"), "left": F.lit(True)})
    right = at.withColumn("__o", F.explode(F.filter(all_, lambda o: o < F.col("__b")))).withColumns({"bi": F.col("__o"), "bj": F.col("__b"), "left": F.lit(False)})
    return left.unionByName(right).drop("__b", "__o"), n


def resolve(df: DataFrame, key: str, label: str, vector: str | None, threshold: float = 0.85, edit_weight: float = 0.3) -> DataFrame:
    """(a, b, score): all pairs with (1 - edit_weight) * cosine + edit_weight * difflib ratio of at
    least ``threshold``. A missing or unusable vector has cosine 0, also where there is no
    vector column at all, and a null label is empty.

    Exact: blocks of rows meet, cosines are products of matrices, and only pairs whose cosine
    leaves the threshold in reach of the labels have their labels compared. Products are of
    single precision less SLACK first, then of double precision. Where labels alone reach
    the threshold, a bound from counted letters goes before."""
    dim_ok = (lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & (F.size(v) > 0)) if vector else None
    element = "float" if vector and df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v = F.when(dim_ok(F.col(vector)), F.col(vector).cast(f"array<{element}>")) if vector else F.lit(None).cast("array<double>")
    x = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(label, F.lit("")).alias("l"), F.coalesce(v, F.array().cast(f"array<{element}>")).alias("v")).dropDuplicates(["k"])
    if vector and edit_weight < threshold:
        x = x.where(F.size("v") > 0)  # without a vector they stay below the threshold
    x = materialize(x, "resolve")
    groups, _ = block_pairs(x, "k", min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, -(-x.count() // BLOCKS))))
    kind = x.schema["k"].dataType.simpleString()
    floor = (threshold - edit_weight) / (1 - edit_weight) - SLACK if edit_weight < 1 else -2.0

    def matrix(t: pa.Table, far: int) -> np.ndarray:
        v = t["v"].combine_chunks()
        size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        m = np.zeros((len(size), far), flat.dtype)
        m[size == far] = flat[np.repeat(size == far, size)].reshape(-1, far)
        return m

    def letters(ls: list[str]) -> np.ndarray:
        m = np.zeros((len(ls), 128), np.float32)
        for i, t in enumerate(ls):
            for c in t:
                m[i, ord(c) & 127] += 1
        return m

    def compare(p: pa.Table) -> pa.Table:
        left = p["left"].to_numpy()
        same = p["bi"][0].as_py() == p["bj"][0].as_py()
        one = p.filter(pa.array(left))
        two = one if same else p.filter(pa.array(~left))
        far = (pc.max(pc.list_value_length(p["v"])).as_py() or 0) if edit_weight < 1 else 0
        ka, kb, la, lb = one["k"].to_pylist(), two["k"].to_pylist(), one["l"].to_pylist(), two["l"].to_pylist()
        va, vb = (matrix(t, far) if far else np.zeros((t.num_rows, 1), np.float32) for t in (one, two))
        na, nb = (np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64)) for m in (va, vb))
        na, nb = (np.where(n > 0, n, 1) for n in (na, nb))
        fa, fb = ((m / n[:, None]).astype(np.float32) for m, n in ((va, na), (vb, nb)))
        out = []

        def near(i: np.ndarray, j: np.ndarray) -> None:
            cos = np.einsum("ij,ij->i", va[i], vb[j], dtype=np.float64) / na[i] / nb[j]
            need = (threshold - (1 - edit_weight) * cos) / edit_weight if edit_weight else np.where(cos >= threshold, -1, 2)
            ok = need <= 1 + 1e-12
            i, j, cos, need = i[ok], j[ok], cos[ok], need[ok]
            ca, cb = letters([la[r] for r in i]), letters([lb[r] for r in j])
            size = ca.sum(1) + cb.sum(1)
            ok = np.where(size > 0, 2 * np.minimum(ca, cb).sum(1) / np.maximum(size, 1), 1.0) >= need - 1e-6
            for r, q, c in zip(i[ok].tolist(), j[ok].tolist(), cos[ok].tolist()):
                a, b = (ka[r], la[r]), (kb[q], lb[q])
                a, b = (a, b) if a[0] < b[0] else (b, a)
                score = (1 - edit_weight) * c + edit_weight * SequenceMatcher(None, a[1], b[1]).ratio()
                if score >= threshold:
                    out.append((a[0], b[0], score))

        for s in range(0, len(ka), 512):
            for t in range(s if same else 0, len(kb), 2048):
                tile = fa[s : s + 512] @ fb[t : t + 2048].T
                i, j = np.divmod(np.flatnonzero(tile >= floor), tile.shape[1])
                i, j = i + s, j + t
                if same:
                    i, j = i[i < j], j[i < j]
                for r in range(0, len(i), 20000):
                    near(i[r : r + 20000], j[r : r + 20000])
        a, b, score = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, p.schema.field("k").type), "b": pa.array(b, p.schema.field("k").type), "score": pa.array(score, pa.float64())})

    return groups.groupBy("bi", "bj").applyInArrow(compare, f"a {kind}, b {kind}, score double")


def merge_candidates(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(component, n, score): groups of matched pairs with their mean score."""
    pairs = materialize(pairs, "pairs")  # read twice, and found by much work
    c = components(pairs.select(F.col("a").cast("string").alias("source_id"), F.col("b").cast("string").alias("target_id")))
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    mean = pairs.select(F.col("a").cast("string").alias("id"), "score").join(c, "id").groupBy("component").agg(F.round(F.avg("score"), 6).alias("score"))
    return size.join(mean, "component")
