"""Registration of queries and of the derived tables they start from.

A derived table is one SELECT that Spark and DuckDB both read; the operators under test
are written with the DataFrame API, their SQL counterparts by hand.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataweave.plans.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings nodes skos_mappings gold_documents gold_entities enriched_entities "
    "enriched_relations merge_candidates kg_snapshots onto_classes skos_concepts processing_configs version_metadata source_targets pack_profiles"
).split()


class Tables:
    """``t.name``: a table of the test data or a derived one."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self._spark, self._path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = VIEWS[name]
            needs = _needs(sql)
            return self._spark.sql(re.sub(r"\$(\w+)", lambda m: "{" + m[1] + "}", sql), **{n: getattr(self, n) for n in needs})
        return self._spark.read.parquet(f"{self._path}/{name}.parquet")


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\$(\w+)", sql)))


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def expand(sql: str) -> str:
    """SQL with the derived tables it names ($name) as leading common table expressions."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        if n in VIEWS and n not in done:
            for m in _needs(VIEWS[n]):
                add(m)
            done[n] = re.sub(r"\$(\w+)", r"\1", VIEWS[n])

    for n in _needs(sql):
        add(n)
    body = re.sub(r"\$(\w+)", r"\1", sql).strip()
    if not done:
        return body
    ctes = ",\n".join(f"{n} AS ({s})" for n, s in done.items())
    if re.match(r"(?i)with recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{body[len('with recursive') :]}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: f(Tables(spark, path))
        if sql:
            ORACLES[name] = sql
        return f

    return add
