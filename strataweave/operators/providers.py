"""Models behind small interfaces, and operators that use them.

A language model, an embedder or a reranker is any object with the method below; it is sent
to the executors and called with a batch at a time. The stand-ins are deterministic, so
results can be repeated; they are no substitute for a model.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.extraction import repair_json


class TextModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """Words hashed to signed places, unit length; the zero vector for no words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


class OverlapReranker:
    """Share of the query's words in a text."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set((t or "").lower().split())) / max(1, len(q)) for t in texts]


class CapitalisedModel:
    """Answers with the capitalised word pairs of the prompt as entities in JSON."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            found = dict.fromkeys(re.findall(r"\b[A-ZÄÖÜ][a-zäöüß]+ [A-ZÄÖÜ][a-zäöüß]+", p))
            out.append("```json\n" + json.dumps({"entities": [{"label": f, "type": "Concept", "confidence": 0.8} for f in found]}) + "\n```")
        return out


class Refused(RuntimeError):
    """The model is not asked, as it failed too often."""


class SteadyModel:
    """A model with retries, a breaker, a cache and counts around it; made on the driver, sent to
    the executors, where each worker counts for itself.

    A call that fails is tried again ``retries`` times, after ``wait`` seconds doubled each time;
    after ``breaker`` failed calls in a row none is made for ``rest`` seconds (``Refused``).
    Answers are kept in ``cache`` (a folder that all executors share, one file a prompt, named
    by its hash), so a prompt is asked once. ``counts``: calls, failures, cache hits, and
    words sent and received. A file is written under another name first and then renamed."""

    def __init__(self, model: TextModel, retries: int = 3, wait: float = 1.0, breaker: int = 5, rest: float = 60.0, cache: str | None = None):
        self.model, self.retries, self.wait, self.breaker, self.rest, self.cache = model, retries, wait, breaker, rest, cache
        self.failed_in_row, self.closed_until = 0, 0.0
        self.counts = {"calls": 0, "failures": 0, "hits": 0, "words_sent": 0, "words_received": 0}

    def _file(self, prompt: str) -> str:
        return os.path.join(self.cache or "", hashlib.sha256(prompt.encode()).hexdigest() + ".txt")

    def _ask(self, prompts: list[str]) -> list[str]:
        for attempt in range(self.retries + 1):
            if time.monotonic() < self.closed_until:
                raise Refused(f"{self.breaker} calls failed in a row")
            self.counts["calls"] += 1
            try:
                out = self.model.complete(prompts)
                self.failed_in_row = 0
                return out
            except Exception:
                self.counts["failures"] += 1
                self.failed_in_row += 1
                if self.failed_in_row >= self.breaker:
                    self.closed_until, self.failed_in_row = time.monotonic() + self.rest, 0
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def complete(self, prompts: list[str]) -> list[str]:
        out: dict[str, str] = {}
        if self.cache:
            for p in set(prompts):
                try:
                    with open(self._file(p), encoding="utf-8") as f:
                        out[p] = f.read()
                    self.counts["hits"] += 1
                except FileNotFoundError:
                    pass
        rest = [p for p in dict.fromkeys(prompts) if p not in out]
        if rest:
            for p, a in zip(rest, self._ask(rest)):
                out[p] = a
                self.counts["words_sent"] += len(p.split())
                self.counts["words_received"] += len(a.split())
                if self.cache:
                    os.makedirs(self.cache, exist_ok=True)
                    draft = f"{self._file(p)}.{os.getpid()}"
                    with open(draft, "w", encoding="utf-8") as f:
                        f.write(a)
                    os.replace(draft, self._file(p))
        return [out[p] for p in prompts]


def model_relations(docs: DataFrame, entities: DataFrame, ontology: DataFrame, key: str, text: str, model: TextModel, threshold: float = 0.5) -> DataFrame:
    """(key, ord, source_id, predicate, target_id, confidence) a model finds between entities (key,
    id, label, entity_type) of a document: answers are JSON after repair, confidence at least
    ``threshold``, both ends are entities of the document (labels compared without case), then
    domain and range and the cardinalities of ``ontology`` (predicate, domain, range,
    functional, inverse_functional) hold. Answers that aren't JSON give none."""
    from strataweave.operators.resolve import cardinality_filter, domain_range_filter

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for k, a in zip(x[key], model.complete([t or "" for t in x[text]])):
                fixed = repair_json(a)
                for i, r in enumerate(json.loads(fixed).get("relations", []) if fixed else []):
                    if r.get("source") and r.get("target") and r.get("predicate") and float(r.get("confidence", 0)) >= threshold:
                        rows.append((k, i, str(r["source"]).lower(), str(r["predicate"]), str(r["target"]).lower(), float(r["confidence"])))
            yield pd.DataFrame(rows, columns=[key, "place", "s", "predicate", "t", "confidence"])

    found = docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, place int, s string, predicate string, t string, confidence double")
    end = lambda c, name: entities.groupBy(key, F.lower("label").alias(c)).agg(F.min("id").alias(name))
    j = found.join(end("s", "source_id"), [key, "s"]).join(end("t", "target_id"), [key, "t"])
    rel = j.select(key, F.xxhash64(key, "place").alias("ord"), "source_id", "predicate", "target_id", "confidence")
    types = entities.groupBy("id").agg(F.concat_ws("|", F.array_sort(F.collect_set("entity_type"))).alias("entity_type"))
    return cardinality_filter(domain_range_filter(rel, types, ontology), ontology)


def with_embeddings(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """Adds the vector of each text, a batch at a time."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed([t or "" for t in s]).astype(np.float32)))

    return df.withColumn(name, run(F.col(text)))


def rerank(hits: DataFrame, query: str, text: str, reranker: Reranker, key: str = "doc_id") -> DataFrame:
    """A top-k list in the reranker's order; equal scores keep the order of ``score``."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(reranker.score(query, list(s)))

    return hits.withColumn("rerank_score", run(F.col(text))).orderBy(F.col("rerank_score").desc(), F.col("score").desc(), key)


def model_entities(docs: DataFrame, key: str, text: str, model: TextModel, threshold: float = 0.5) -> DataFrame:
    """(key, label, entity_type, confidence) a model finds; answers that aren't JSON after repair give none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for k, a in zip(x[key], model.complete([t or "" for t in x[text]])):
                fixed = repair_json(a)
                for e in json.loads(fixed).get("entities", []) if fixed else []:
                    if float(e.get("confidence", 0)) >= threshold and e.get("label"):
                        rows.append((k, e["label"], e.get("type", ""), float(e["confidence"])))
            yield pd.DataFrame(rows, columns=[key, "label", "entity_type", "confidence"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, label string, entity_type string, confidence double")


def fill_missing(df: DataFrame, column: str, prompt: str, model: TextModel) -> DataFrame:
    """Rows whose ``column`` is null or blank get the model's answer to the column ``prompt``;
    only these rows reach the model."""

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        return pd.Series(model.complete([t or "" for t in s]))

    blank = F.coalesce(F.trim(F.col(column)) == "", F.lit(True))
    return df.where(~blank).unionByName(df.where(blank).withColumn(column, ask(F.col(prompt))))


def enrichment_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows have each field."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col(c).isNotNull(), 1)).alias(f"with_{c}") for c in columns))
