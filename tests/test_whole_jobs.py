"""Queries and operators that must do the whole of their job."""

import pytest
from pyspark.sql import functions as F

from strataweave import core_queries
from strataweave.operators import embeddings, structural
from strataweave.queries import registry

DATA = "/root/testdata/sf0.001"


def run(spark, name):
    return core_queries.queries()[name](spark, DATA)


def test_all_labels_are_clustered(spark):
    n = spark.read.parquet(f"{DATA}/part.parquet").count()
    d1 = run(spark, "D1_synthesis_clusters")
    assert d1.count() == d1.select("id").distinct().count() == n
    assert run(spark, "D5_dedup_map").agg(F.sum("n_members")).first()[0] == n


@pytest.fixture(scope="module")
def path(spark):
    return spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "t") for i in range(6)] + [("e9", "n0", "n2", "t")], "id string, source_id string, target_id string, edge_type string")


def test_iterations_end_within_tolerance_or_fail(path):
    for call in (lambda: structural.eigenvector(path, most=2), lambda: structural.hits(path, most=1), lambda: structural.non_backtracking(path, rounds=2)):
        with pytest.raises(RuntimeError, match="tolerance"):
            call()
    with pytest.warns(UserWarning, match="labels still change"):
        structural.propagate_labels(path, 1)


def test_trials_and_walks_of_the_survey(spark):
    assert run(spark, "A22_bootstrap").first()["trials"] == 100
    edges = registry.Tables(spark, DATA).k_edges
    want = embeddings.walk_cooccurrence(edges, walks=10, length=20, window=5).groupBy("u").count()
    assert {tuple(r) for r in run(spark, "B8_walk_embedding").collect()} == {tuple(r) for r in want.collect()}


def test_evidence_of_all_line_items(spark):
    l = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", F.expr("l_suppkey % 7")).distinct()
    parts = spark.read.parquet(f"{DATA}/part.parquet").select(F.col("p_partkey").alias("l_partkey"))
    assert run(spark, "G16_assemble").agg(F.sum("evidence_count")).first()[0] == l.join(parts, "l_partkey").count()


def test_all_labels_of_all_concepts(spark):
    assert run(spark, "E24_cooccurrence").join(spark.read.parquet(f"{DATA}/skos_concepts.parquet").where("broader_id is not null"), "concept_id").count() > 0
