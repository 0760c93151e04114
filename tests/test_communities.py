"""Communities, resolution, embeddings, loaders and models on small inputs with known results."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.operators import embeddings, merging, providers, structural
from strataweave.sources import readers


@pytest.fixture(scope="module")
def cliques(spark):
    """Three groups of five that are joined in a ring."""
    e = [(f"g{g}{i}", f"g{g}{j}") for g in range(3) for i in range(5) for j in range(i)] + [("g00", "g10"), ("g11", "g20"), ("g21", "g01"), ("g00", "g00"), ("g00", "g10")]
    return spark.createDataFrame([(f"e{i}", a, b, "t") for i, (a, b) in enumerate(e)], "id string, source_id string, target_id string, edge_type string")


@pytest.mark.parametrize("method", [structural.louvain, structural.greedy_modularity])
def test_communities(spark, cliques, method):
    got = {}
    for r in method(cliques).collect():
        got.setdefault(r.community, set()).add(r.id)
    assert {frozenset(v) for v in got.values()} == {frozenset(f"g{g}{i}" for i in range(5)) for g in range(3)} and all(min(v) == k for k, v in got.items())
    assert method(cliques.limit(0)).count() == 0


def test_louvain_is_no_worse_than_label_propagation(spark):
    rng = np.random.default_rng(4)
    e = [(f"n{a:03d}", f"n{b:03d}") for a in range(90) for b in range(a) if rng.random() < (0.35 if a % 6 == b % 6 else 0.02)]
    d = spark.createDataFrame([(f"e{i}", a, b, "t") for i, (a, b) in enumerate(e)], "id string, source_id string, target_id string, edge_type string")
    q = lambda p: structural.modularity(d, p).first()["modularity"]
    planted = q(structural.degrees(d.selectExpr("source_id as id").union(d.selectExpr("target_id")).distinct(), d).select("id", (F.substring("id", 2, 3).cast("int") % 6).cast("string").alias("community")))
    assert q(structural.louvain(d)) >= planted - 0.02 and q(structural.greedy_modularity(d)) >= 0.5 * planted


def test_resolver(spark):
    """Vectors and labels together, labels alone where there are no vectors, against all pairs."""
    from difflib import SequenceMatcher

    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 8))
    rows = [(i, f"label number {i // 2} {'x' * (i % 3)}", None if i % 11 == 0 else (base[i // 2] + 0.15 * rng.standard_normal(8)).tolist()) for i in range(80)] + [(900, None, [float("nan")] * 8), (901, "label number 3", [0.0] * 8), (3, "label number 1 ", None)]
    rows = rows[:-1]
    d = spark.createDataFrame(rows, "id long, label string, v array<double>").withColumn("left", F.lit("clash"))

    def unit(v):
        n = np.linalg.norm(v) if v is not None and np.isfinite(v).all() else 0
        return np.array(v) / n if n else np.zeros(8)

    for vector, weight, least in (("v", 0.3, 0.85), ("v", 0.95, 0.9), (None, 1.0, 0.9), ("v", 0.0, 0.9)):
        want = set()
        for i, (a, la, va) in enumerate(rows):
            for b, lb, vb in rows[:i]:
                s = (1 - weight) * float(unit(va) @ unit(vb) if vector else 0) + weight * SequenceMatcher(None, *((lb or "", la or "") if b < a else (la or "", lb or ""))).ratio()
                if s >= least:
                    want.add((min(a, b), max(a, b)))
        got = {(r.a, r.b) for r in merging.resolve(d, "id", "label", vector, least, weight).collect()}
        assert got == want and want
    assert merging.resolve(d.limit(0), "id", "label", "v").count() == 0


def test_block_pairs_meet_once(spark):
    g, n = merging.block_pairs(spark.range(50).withColumnRenamed("id", "k"), "k", 8)
    seen = {}
    for r in g.collect():
        seen.setdefault((r.bi, r.bj), {True: [], False: []})[r.left].append(r.k)
    pairs = [tuple(sorted((a, b))) for (i, j), s in seen.items() for a in s[True] for b in (s[False] if i != j else [x for x in s[True] if x > a])]
    assert n > 1 and len(pairs) == len(set(pairs)) == 50 * 49 // 2


def test_cluster_quality(spark):
    rng = np.random.default_rng(1)
    v, c = rng.standard_normal((60, 3)), rng.integers(0, 3, 60)
    v += c[:, None] * 3.0
    dist = np.linalg.norm(v[:, None] - v[None], axis=2)
    s = []
    for i in range(60):
        means = {k: dist[i, (c == k) & (np.arange(60) != i)].mean() for k in range(3)}
        a, b = means[c[i]], min(m for k, m in means.items() if k != c[i])
        s.append((b - a) / max(a, b))
    inertia = sum(((v[c == k] - v[c == k].mean(0)) ** 2).sum() for k in range(3))
    r = embeddings.cluster_quality(spark.createDataFrame([(i, v[i].tolist(), int(c[i])) for i in range(60)], "id long, v array<double>, c long"), "id", "v", "c").first()
    assert r.silhouette == pytest.approx(np.mean(s), abs=1e-5) and r.inertia == pytest.approx(inertia, abs=1e-3) and r.n_clusters == 3


def test_walk_embedding(spark, cliques):
    """The singular values and the subspace are those of the dense matrix."""
    w = embeddings.walk_cooccurrence(cliques).toPandas()
    ids = sorted(set(w["u"]) | set(w["v"]))
    m = np.zeros((len(ids), len(ids)))
    for u, v, x in w.itertuples(index=False):
        m[ids.index(u), ids.index(v)] = m[ids.index(v), ids.index(u)] = x
    e = {r.id: r.embedding for r in embeddings.walk_embedding(cliques, dim=4, steps=30).collect()}
    got = np.array([e[i] for i in ids])
    assert np.linalg.norm(got, axis=0) == pytest.approx(np.linalg.svd(m)[1][:4], rel=0.05)
    assert embeddings.walk_embedding(cliques.limit(0)).count() == 0


def test_small_world(spark, cliques):
    nodes = cliques.selectExpr("source_id as id").union(cliques.selectExpr("target_id")).distinct()
    r = structural.small_world_sampled(nodes, cliques).first()
    assert r.sigma > 1 and 0 < r.random_clustering < r.mean_clustering
    assert structural.small_world_sampled(nodes.limit(2), cliques).count() == 0


def _office(kind):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if kind == "docx":
            z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>part</w:t></w:r></w:p><w:p/><w:tbl><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tbl><w:p><w:r><w:t>Zweiter ä</w:t></w:r></w:p></w:body></w:document>')
        else:
            for n, t in ((10, "last"), (2, "second"), (1, "first")):
                z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p/></p:txBody></p:sp></p:sld>')
    return out.getvalue()


def test_office_files(spark, tmp_path):
    for k in ("docx", "pptx"):
        (tmp_path / f"a.{k}").write_bytes(_office(k))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.xyz").write_text("?")
    got = {r.path.rpartition("/")[2]: (r.content, r.error) for r in readers.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("First part\n\nZweiter ä", None) and got["a.pptx"] == ("first\n\nsecond\n\nlast", None)
    assert got["broken.docx"][0] is None and "BadZipFile" in got["broken.docx"][1] and got["b.txt"] == ("plain", None) and got["c.xyz"] == (None, "unknown suffix")


class Flaky:
    def __init__(self, failures):
        self.left = failures

    def complete(self, prompts):
        if self.left:
            self.left -= 1
            raise ConnectionError("down")
        return [p.upper() for p in prompts]


def test_steady_model(tmp_path):
    m = providers.SteadyModel(Flaky(2), retries=3, wait=0, cache=str(tmp_path / "answers"))
    assert m.complete(["a b", "c", "a b"]) == ["A B", "C", "A B"] and m.counts == {"calls": 3, "failures": 2, "hits": 0, "words_sent": 3, "words_received": 3}
    again = providers.SteadyModel(Flaky(99), retries=0, wait=0, cache=str(tmp_path / "answers"))
    assert again.complete(["c"]) == ["C"] and again.counts["hits"] == 1 and again.counts["calls"] == 0
    broken = providers.SteadyModel(Flaky(99), retries=1, wait=0, breaker=2, rest=60)
    with pytest.raises(ConnectionError):
        broken.complete(["x"])
    with pytest.raises(providers.Refused):
        broken.complete(["x"])


class Relations:
    def complete(self, prompts):
        return ['```json\n{"relations": [{"source": "Plant", "predicate": "locatedIn", "target": "TOWN", "confidence": 0.9}, {"source": "Plant", "predicate": "locatedIn", "target": "Other", "confidence": 0.8}, {"source": "Town", "predicate": "locatedIn", "target": "Plant", "confidence": 0.9}, {"source": "Plant", "predicate": "near", "target": "nowhere", "confidence": 0.9}, {"source": "Plant", "predicate": "near", "target": "Town", "confidence": 0.2}]}\n```' if p else "no json" for p in prompts]


def test_model_relations(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id int, text string")
    ent = spark.createDataFrame([(1, "e1", "Plant", "Facility"), (1, "e2", "Town", "Location"), (1, "e3", "Other", "Location")], "doc_id int, id string, label string, entity_type string")
    onto = spark.createDataFrame([("locatedIn", ["Facility"], ["Location"], True, False)], "predicate string, domain array<string>, range array<string>, functional boolean, inverse_functional boolean")
    got = [(r.source_id, r.predicate, r.target_id) for r in providers.model_relations(docs, ent, onto, "doc_id", "text", Relations()).collect()]
    assert got == [("e1", "locatedIn", "e2")]


def test_settings_and_report(spark, tmp_path):
    from strataweave.operators.settings import Experiment, Variant
    from strataweave.sources.export import markdown_table

    e = Experiment("x", [Variant("a"), Variant("b", 0.75, parameters={"k": 3})], 2, ["Wer?"])
    e.save(str(tmp_path / "e.json"))
    assert Experiment.load(str(tmp_path / "e.json")) == e and e.problems() == []
    bad = Experiment(" ", [Variant("a", 1.5), Variant("a", iterations=0)], 0)
    assert len(bad.problems()) == 5
    bad.save(str(tmp_path / "bad.json"))
    with pytest.raises(ValueError, match="outside"):
        Experiment.load(str(tmp_path / "bad.json"))
    d = spark.createDataFrame([("a|b", 0.5), (None, 2.0)], "name string, v double")
    assert markdown_table(d, "T") == "## T\n\n| name | v |\n| --- | --- |\n| a\\|b | 0.5 |\n|  | 2 |\n"
    with pytest.raises(ValueError):
        markdown_table(d, "T", 1)
