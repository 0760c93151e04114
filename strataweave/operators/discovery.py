"""Loops over whole DataFrames: discovery until coverage, build until the gates are met."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.experiments import coverage
from strataweave.plans.lineage import write_stage

#: (iteration, classes not yet covered) -> findings (label, entity_type, confidence, ...).
Finder = Callable[[int, DataFrame], DataFrame]


def discover(find: Finder, classes: DataFrame, kind: str = "entity_type", target: float = 0.85, most: int = 5) -> tuple[DataFrame, list[float]]:
    """(findings of all iterations, coverage after each): asks for the classes not yet found
    until their share is ``target``, none is left, or ``most`` iterations are done. Each
    iteration is written, so the plan doesn't grow."""
    found, seen = None, []
    for i in range(most):
        left = classes if found is None else classes.join(found.select(kind).distinct(), kind, "left_anti")
        if left.isEmpty():
            break
        new = write_stage(find(i, left).withColumn("iteration", F.lit(i)), "discovery").df
        found = new if found is None else found.unionByName(new)
        seen.append(coverage(found, classes, kind).first()["coverage"])
        if seen[-1] >= target:
            break
    return found, seen


def build(step: Callable[[int], dict[str, float]], gates: dict[str, float], most: int = 10) -> list[dict]:
    """Measurements of each iteration of ``step`` until every gate is met or ``most`` are done;
    the last names what wasn't met. Measurements come from the caller's data, never from formulas."""
    log = []
    for i in range(most):
        got = step(i)
        missing = [k for k, v in gates.items() if got.get(k, 0.0) < v]
        log.append({"iteration": i, **got, "missing": missing})
        if not missing:
            break
    return log


def process_new(docs: DataFrame, done: DataFrame, text: str) -> DataFrame:
    """Documents whose content hash isn't among the processed ones (hash)."""
    return docs.withColumn("hash", F.sha2(text, 256)).join(done.select("hash"), "hash", "left_anti")


def pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, content): blank-line blocks as pages."""
    return df.select(key, F.posexplode(F.filter(F.split(text, r"\n\s*\n"), lambda x: F.trim(x) != "")).alias("page", "content"))
