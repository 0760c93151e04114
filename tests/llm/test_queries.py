"""The queries on the smallest tables: against SQL where there is any, else for the columns
asked for, rows at all and the same rows again."""

import pytest

from strataweave.llm import queries
from tests.compare import connect, same

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["field_name", "record_key", "entry_id"], "p2_found": ["doc_id", "case_kind"], "p3_found": ["entity_id", "record_id"], "p4_found": ["collection", "id_a", "id_b"],
    "p5_found": ["node_id", "group_id"], "p7_found": ["key_a", "key_b"], "p10_found": ["doc_id", "lang_found"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    run, sql = queries.queries()[name], queries.oracle_sql().get(name)
    q = run(spark, DATA)
    assert q.columns == COLUMNS.get(name, q.columns)
    if sql:
        same(q, connect(DATA), sql)
    else:
        rows = sorted(map(str, q.collect()))
        assert rows and rows == sorted(map(str, run(spark, DATA).collect()))


def test_mixture_of_the_size_of_the_corpus_is_bisected(spark):
    q = queries.queries()
    plain, corpus = (q[n](spark, DATA).toPandas() for n in ("p9_shares", "p9_corpus_shares"))
    assert corpus["tokens_taken"].sum() > plain["tokens_taken"].sum()
    assert (corpus["most_repeats"] <= corpus["max_repeats"]).all()
    there = corpus["target_share"].where(corpus["tokens_there"] > 0, 0)
    assert (abs(corpus["planned_share"] - there / there.sum()) > 1e-3).any()  # an exponent below 1
