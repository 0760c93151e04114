"""Values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions.text import entity_id, positional_similarity
from strataweave.operators import chunking, confidence, embeddings, experiments, extraction, graph, inference, linking, resolve, retrieval, snapshots, structural, validation

TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("a", "x")]


@pytest.fixture(scope="module")
def two(spark):
    n = spark.createDataFrame([(i, "Person" if i in "abc" else "Organization", i, 0.5) for i in "abcxyz"], "id string, node_type string, label string, confidence double")
    e = spark.createDataFrame([(f"e{i}", s, t, "knows") for i, (s, t) in enumerate(TRIANGLES)], "id string, source_id string, target_id string, edge_type string")
    return n, e


def test_entity_id(spark):
    assert spark.range(1).select(entity_id(F.lit(" Acme\n"), F.lit("Org"))).first()[0] == "ent_8f4fd3abce3d"


def test_boost(spark):
    d = spark.createDataFrame([(1, 0.7, 2, "Action"), (2, 0.7, 3, "x"), (3, 0.995, 0, "x")], "k int, confidence double, n_sources int, entity_type string")
    assert [round(r.confidence, 6) for r in confidence.boost(d).orderBy("k").collect()] == [0.825, 0.85, 0.99]


def test_merges(spark):
    d = spark.createDataFrame([(1, "i1", "Acme", "t", 0.6), (2, "i2", "acme ", "t", 0.8)], "ord int, id string, label string, entity_type string, confidence double")
    r = resolve.ensemble_merge(d).collect()
    assert [(x.id, x.confidence, x.n) for x in r] == [("i2", 0.8, 2)]
    g = spark.createDataFrame([(1, "a", "x", "g", 0.9), (2, "b", "x", "g", 0.8), (3, "c", "x", "g", 0.7)], "ord int, id string, label string, grp string, confidence double")
    assert resolve.merge_groups(g, "grp", 0.05, 0.1, 1.0).first().confidence == 0.9
    assert resolve.merge_groups(g.where("ord < 3"), "grp", 1.0, 0.05, 0.99, True).first().confidence == 0.9


def test_fixed_chunks(spark):
    d = spark.createDataFrame([(1, "x" * 1000), (2, ""), (3, None)], "k int, t string")
    r = chunking.fixed_size(d, "k", "t").orderBy("start_char").collect()
    assert [(x.start_char, x.end_char) for x in r] == [(0, 512), (437, 974), (899, 1000)]


def test_packed_paragraphs(spark):
    d = spark.createDataFrame([(1, "aa\n\nbb\n\ncccccc\n\nd")], "k int, t string")
    r = chunking.packed_paragraphs(d, "k", "t", 4).orderBy("chunk_no").collect()
    assert [(x.start_char, x.content) for x in r] == [(0, "aa\n\nbb"), (8, "cccccc"), (16, "d")]


def test_sections(spark):
    d = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny")], "k int, t string")
    r = chunking.sections(d, "k", "t").orderBy("section_no").collect()
    assert [(x.heading, x.level, x.start_char, x.section_index) for x in r] == [(None, 0, 0, 1), ("A", 1, 6, 3), ("B", 2, 12, None)]


def test_retrieval(spark):
    d = spark.createDataFrame([("a", "hello world"), ("b", "foo bar")], "doc_id string, text string")
    assert [tuple(r) for r in retrieval.sparse_scores(d, "hello").collect()] == [("a", 0.5)]
    k = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True)], "query_id int, rank int, relevant boolean")
    assert retrieval.ranking_metrics(k, cutoffs=(3,)).first()["ndcg_3"] == round((1 + 1 / 2) / (1 + 1 / math.log2(3)), 6)


def test_positional(spark):
    assert spark.range(1).select(positional_similarity(F.lit("abcd"), F.lit("abxd1"))).first()[0] == pytest.approx(0.6)
    assert spark.range(1).select(positional_similarity(F.lit(""), F.lit(""))).first()[0] == 1.0


def test_rules(spark):
    e = spark.createDataFrame([("1", "a", "b", "p"), ("2", "b", "c", "p"), ("3", "a", "x", "f"), ("4", "a", "y", "f"), ("5", "a", "z", "f")], "id string, source_id string, target_id string, edge_type string")
    assert [tuple(r) for r in validation.transitive_violations(e, "p").collect()] == [("a", "p", "c")]
    assert sorted(r.target_id for r in validation.functional_violations(e, "f").collect()) == ["y", "z"]
    assert spark.range(1).select(validation.pass_rate(F.lit(1), F.lit(3), F.lit(1)), validation.pass_rate(F.lit(0), F.lit(0), F.lit(0))).first()[:] == (0.75, 1.0)
    assert inference.materialise_transitive(e, "p").count() == 1
    assert inference.missing_reverse(e, ["p"]).count() == 2


def test_graph(two):
    n, e = two
    assert graph.statistics(n, e).first()["density"] == round(7 / 30, 9)
    assert {r.id: r.hops for r in graph.k_hop(e, n.where("id = 'a'"), 2).collect()} == {"a": 0, "b": 1, "c": 1, "x": 1, "y": 2, "z": 2}
    assert structural.clustering(n, e).first()["transitivity"] == 0.6
    assert structural.components(e).select("component").distinct().count() == 1
    assert structural.components(e.where("id <> 'e6'"), n).groupBy("component").count().count() == 2
    assert [tuple(r) for r in structural.bridges(e).collect()] == [("a", "x")]
    assert structural.path_lengths(e).first()["diameter"] == 3
    ranks = {r.id: r.rank for r in structural.pagerank(n, e).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-6)
    b = {r.id: r.betweenness for r in structural.path_centralities(e).collect()}
    assert b["a"] == pytest.approx(0.6) and b["b"] == 0
    assert {r.id for r in structural.eigenvector(e).orderBy(F.desc("x")).limit(2).collect()} == {"a", "x"}


def test_snapshot_changes(spark):
    v = spark.createDataFrame([("v1", 1), ("v2", 2), ("v3", 3)], "version_id string, created_at int")
    s = "version_id string, entity_id string, label string, node_type string, description string, confidence double, props map<string,string>, loaded_at int, extra string"
    row = lambda ver, k, label, at=1, props=None: (ver, k, label, "t", None, 0.5, props, at, "e")
    d = spark.createDataFrame(
        [row("v1", "1", "a"), row("v1", "2", "b"), row("v1", "2", "old", 0), row("v2", "2", "B"), row("v2", "3", "c", 1, {"x": "1", "y": "2"}), row("v2", "3", "c", 1, {"x": "1", "y": "2"}), row("v2", None, "n"), row("vX", "9", "n"), row("v3", "3", "c", 1, {"y": "2", "x": "1"}), row("v3", "2", None)], s
    )
    got = {tuple(r) for r in snapshots.snapshot_changes(d, v).collect()}
    assert got == {("v1", "v2", "1", "removed"), ("v1", "v2", "2", "changed"), ("v1", "v2", "3", "added"), ("v2", "v3", "2", "changed")}
    assert snapshots.snapshot_changes(d.limit(0), v).count() == 0 and snapshots.snapshot_changes(d, v.limit(0)).count() == 0
    lost = {tuple(r)[2:] for r in snapshots.snapshot_changes(d.where("version_id <> 'v2'"), v).collect()}
    assert lost == {("1", "removed"), ("2", "removed"), ("2", "added"), ("3", "added")}


def test_isotonic():
    y = confidence.pool_adjacent(np.arange(5), np.array([1, 3, 2, 4, 3.0]), np.ones(5))
    assert y.tolist() == [1, 2.5, 2.5, 3.5, 3.5]


def test_alignment(spark):
    d = spark.createDataFrame([("the full text", "full"), ("the full text", "absent!"), ("abcdefghij", "abcdefghiX")], "t string, s string")
    assert [r.status for r in extraction.align(d, "t", "s").collect()] == ["exact", "missing", "fuzzy"]


def test_repairs():
    assert extraction.repair_json('```json\n{"a": [1, 2\n```') == '{"a": [1, 2]}'
    assert extraction.repair_json("none") is None
    assert [extraction.integer_value(x) for x in ("12", "3 + 4*2", "__import__('os')", "")] == [12, 11, None, None]


def test_stopping_and_votes(spark):
    d = spark.createDataFrame([(0.9, 0.95, 0.8, 20, 1), (0.5, 0.95, 0.8, 20, 1), (0.5, 0.1, 0.1, 0, 10)], "a double, v double, c double, n int, i int")
    stop, why = experiments.stopping(F.col("a"), F.col("v"), F.col("c"), F.col("n"), F.col("i"))
    assert [tuple(r) for r in d.select(stop, why).collect()] == [(True, "all met"), (False, "questions"), (True, "max iterations")]


def test_links(spark):
    d = spark.createDataFrame([(1, "nach § 7 Abs. 3 AtG und § 4 Absatz 1 sowie Art. 12 BBergG"), (2, None)], "k int, t string")
    got = {(r.law_code, r.section) for r in linking.explicit_citations(d, "k", "t").collect()}
    assert {("AtG", "7 Abs. 3"), ("AtG", "4 Abs. 1"), ("BBergG", "Art. 12")} <= got
    e = spark.createDataFrame([(1, "AtG", "7", 0.9)], "id int, law string, section string, confidence double")
    k = spark.createDataFrame([(1, "AtG", "7", 0.8), (2, "AtG", None, 0.8)], e.schema)
    f = spark.createDataFrame([(2, "X", "1", 0.5), (3, "X", "1", 0.5)], e.schema)
    assert sorted((r.id, r.reason) for r in linking.cascade(e, k, f).collect()) == [(1, "explicit"), (2, "keyword"), (3, "default")]


def test_coherence(spark):
    d = spark.createDataFrame([("g", [1.0, 0.0]), ("g", [0.0, 1.0]), ("h", [1.0, 1.0])], "g string, v array<double>")
    assert [tuple(r) for r in embeddings.coherence(d, "g", "v", 2).collect()] == [("g", 0.0)]


def test_sources(spark, tmp_path):
    from strataweave.sources import export, readers

    (tmp_path / "a.html").write_text("<p>Hello <b>you</b></p><script>x</script>")
    (tmp_path / "b.TXT").write_text("plain")
    (tmp_path / "c.zip").write_text("?")
    got = {r.path.rsplit("/", 1)[1]: (r.file_type, r.content, r.error) for r in readers.load_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.html": ("html", "Hello you", None), "b.TXT": ("txt", "plain", None), "c.zip": (None, None, "unknown suffix")}
    (tmp_path / "law").mkdir()
    (tmp_path / "law" / "BJNR1.xml").write_text("<dokumente><norm><metadaten><titel>G</titel></metadaten></norm><norm><metadaten><enbez>§ 1</enbez><titel>Zweck</titel></metadaten><textdaten><text><Content><P>Ein <B>Satz</B>.</P></Content></text></textdaten></norm></dokumente>")
    law = readers.read_laws(spark, str(tmp_path / "law")).orderBy("pos").collect()
    assert [(r.enbez, r.title, r.text, r.norm_type) for r in law] == [(None, "G", None, "METADATA"), ("§ 1", "Zweck", "Ein Satz.", "PARAGRAPH")]
    n = spark.createDataFrame([("a b", "T", 'say "x"')], "id string, node_type string, label string")
    e = spark.createDataFrame([("1", "a b", "c", "is-a")], "id string, source_id string, target_id string, edge_type string")
    lines = {r.line for r in export.to_turtle(n, e).collect()}
    assert lines == {"<http://example.org/kg/a%20b> a :T .", '<http://example.org/kg/a%20b> rdfs:label "say \\"x\\"" .', "<http://example.org/kg/a%20b> :is_a :c ."}
    for f in export.FORMATS:
        export.export(n, e, f, str(tmp_path / f"out_{f}"))
    with pytest.raises(ValueError):
        export.export(n, e, "pdf", str(tmp_path / "x"))
    readers.save_version(n, e, str(tmp_path / "v"), "v1")
    assert readers.load_version(spark, str(tmp_path / "v"), "v1")[0].count() == 1
    c, r = readers.read_turtle_classes(spark, "@prefix x: <y> .\n:A a owl:Class ;\n rdfs:subClassOf :B .\n:p a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :B .\n")
    assert c.collect()[0][:] == ("A", "B") and r.collect()[0][:] == ("p", "A", "B")


def test_stream(spark, tmp_path):
    from strataweave.streaming.events import windowed_counts

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.limit(200).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(s, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 200


def test_skewed_join(spark):
    from strataweave.plans.skew import join_unique

    big = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    for how in ("inner", "left"):
        assert sorted(map(tuple, join_unique(big, small, "k", how).collect()), key=str) == sorted(map(tuple, big.join(small, "k", how).select("k", "id", "v").collect()), key=str)


def test_hot_keys(spark):
    from strataweave.plans.skew import hot_keys, join_spread

    big = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id", (F.col("id") % 4000).alias("b"))
    h = lambda x: spark.sql(f"select xxhash64({x})").first()[0]
    assert hot_keys(big, "k", "b") == [{h("'hot'"), h("cast(null as string)")}, set()]
    assert hot_keys(big.where("false"), "k") == [set()]
    twice = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "k string, v int")
    assert sorted(map(tuple, join_spread(big, twice, "k").collect())) == sorted(map(tuple, big.join(twice, "k").select("k", "id", "b", "v").collect()))
