"""The operators on small and awkward inputs: nulls, blanks, ties, repeats, empty tables,
clashing columns; against brute force or round trips where there is no SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import canonical, components, language, mixing, name_parts, names, neighbours, packing, splitting, survivors, tokens

RNG = random.Random(5)


# 1 -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def entries(spark):
    t = spark.createDataFrame([("c1", "Organization", ["Körperschaft", None]), ("c2", "LegalProvision", ["Norm"]), ("c3", "Prüfung Maschinenhaus", None), (None, "x", None), ("c4", None, ["Drum"])], "id string, name string, alts array<string>")
    return canonical.entry_forms(t, "id", "name", "alts")


def test_canonical(spark, entries):
    cases = {
        "Organization": "c1", " ORGANIZATION ": "c1", "http://example.org/x#Organization": "c1", "ns:Organization": "c1", "Orgalnizaticon": "c1", "organizations": "c1", "Koerperschaft": "c1", "Organiza.": "c1", "Organization / neu": "c1",
        "legal-provisions": "c2", "LEGAL_PROVISION": "c2", "Legal Prov.": "c2", "norm": "c2", "Maschinenhaus, Prüfung": "c3", "Prüfung der Maschinenhaus": "c3", "Prüfung Kaffeemaschine": None, "": None, " ": None, "???": None, "Kantine": None, "drum": "c4", "x" * 5000: None,
    }
    v = spark.createDataFrame([(k,) for k in cases] + [(None,), ("Organization",)], "value string").withColumn("plain", F.lit(1))
    got = {r.value: r.entry_id for r in canonical.match_list(v, entries).collect()}
    assert got == cases
    assert canonical.match_list(v.limit(0), entries).count() == 0
    assert {r.entry_id for r in canonical.match_list(v, entries.limit(0)).collect()} == {None}


def brute_force(values, entries):
    """The entry of each value by comparing it with every entry."""
    from strataweave.llm.canonical import _short_vowels

    tok = lambda t: set(canonical.tokens(_short_vowels(t)))
    forms = sorted({(k, p, f, c) for k, e in entries for p in [canonical.plain(e)[0]] if p for f, c in [(p, False), *((x, True) for x in canonical.cut_forms(p))]})
    sets = [tok(f) for _, _, f, _ in forms]
    out = {}
    for v in values:
        found = []
        for place, (p, cut) in enumerate(canonical.readings(v)):
            t = tok(p)
            near = [(-len(t & s) / len(t | s), c, p != f, k, e) for (k, e, f, c), s in zip(forms, sets) if cut or not c]
            best = min(near, default=(0,))
            if -best[0] >= canonical.MIN_SIMILARITY and canonical.edits(p, cut, best[4]) is not None:
                found.append((best[0], place, best[3]))
        out[v] = min(found)[2] if found else None
    return out


def test_prefix_join_is_exact(spark):
    """No pair of the wanted similarity is lost: against all pairs."""
    words = ["".join(RNG.choice("abcde") for _ in range(RNG.randint(3, 9))) for _ in range(60)]
    words += [w + " " + words[-i] for i, w in enumerate(words[:20])] + [w[: len(w) - 2] + "." for w in words[:20]]
    e = [(f"e{i:02d}", w) for i, w in enumerate(words[:20] + words[60:70])] + [("z", "abcab")]
    got = {r.value: r.entry_id for r in canonical.match_list(spark.createDataFrame([(w,) for w in words], "value string"), spark.createDataFrame(e, "entry_id string, form string")).collect()}
    assert got == brute_force(set(words), e)


def test_both_ways_of_the_prefix_join(spark, monkeypatch):
    """The shuffled join, for long lists, gives what the index gives."""
    words = ["".join(RNG.choice("abcde") for _ in range(RNG.randint(3, 9))) for _ in range(60)]
    words += [w + " " + words[-i] for i, w in enumerate(words[:20])] + [w[: len(w) - 2] + "." for w in words[:20]]
    v, e = spark.createDataFrame([(w,) for w in words], "value string"), spark.createDataFrame([(f"e{i:02d}", w) for i, w in enumerate(words[:30])], "entry_id string, form string")
    one = sorted(map(tuple, canonical.match_list(v, e).collect()), key=str)
    monkeypatch.setattr(canonical, "BROADCAST_FORMS", 0)
    assert sorted(map(tuple, canonical.match_list(v, e).collect()), key=str) == one


def test_whole_values_are_read(spark, entries):
    """All parts of a value are matched, and entries of any number of words."""
    e = entries.unionByName(spark.createDataFrame([("w5", "alpha bravo charlie delta echo")], "entry_id string, form string"))
    cases = {"siehe Anhang; Organization": "c1", "Kantine / Organization": "c1", "Kantine (Norm)": "c2", "echo delta charlie bravo alpha": "w5", "delta alpha ecoh bravo charlie": "w5", "Prüfung - Maschinenhaus": "c3"}
    got = {r.value: r.entry_id for r in canonical.match_list(spark.createDataFrame([(k,) for k in cases], "value string"), e).collect()}
    assert got == cases


@pytest.mark.parametrize("table, value, refs, key, name", [("nodes", "node_type", "onto_classes", "class_id", "class_name"), ("skos_mappings", "entity_label", "skos_concepts", "concept_id", "pref_label")])
def test_canonical_on_whole_tables(spark, table, value, refs, key, name):
    d = "/root/testdata/sf0.001"
    v = spark.read.parquet(f"{d}/{table}.parquet").select(F.col(value).alias("value")).where("value is not null").distinct()
    e = canonical.entry_forms(spark.read.parquet(f"{d}/{refs}.parquet"), key, name, "alt_labels")
    got = {r.value: r.entry_id for r in canonical.match_list(v, e).collect()}
    assert got == brute_force([r.value for r in v.collect()], [tuple(r) for r in e.distinct().collect()])


# 2 -------------------------------------------------------------------------------------


def pieces(spark, rows):
    d = spark.createDataFrame(rows, "doc_id string, text string, z int, o int").withColumn("piece", F.lit("clash"))
    return splitting.split_texts(d, "doc_id", "text", "z", "o").orderBy("doc_id", "piece_no").collect()


def test_splitting(spark):
    long = " ".join("".join(RNG.choice("abcdefg") for _ in range(RNG.randint(1, 12))) + RNG.choice(["", ".", ",", "\n", "\n\n"]) for _ in range(4000))
    got = pieces(spark, [("a", long, 200, 30), ("b", "x" * 1000, 100, 10), ("c", "", 10, 0), ("d", None, 10, 0), ("e", "ä😀 b" * 50, 16, 0), ("f", "short", None, None), ("g", "word " * 40, 10, 99), ("h", long * 8, 500, 50)])
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert "d" not in by and [r.piece for r in by["c"]] == [""] and len(by["f"]) == 1
    for k, text, z, o in (("a", long, 200, 30), ("b", "x" * 1000, 100, 10), ("e", "ä😀 b" * 50, 16, 0), ("g", "word " * 40, 10, 9), ("h", long * 8, 500, 50)):
        p = by[k]
        assert all(r.piece == text[r.start_char : r.end_char] and 0 < len(r.piece) <= z for r in p)
        assert all(b.start_char == a.end_char - o for a, b in zip(p, p[1:])) and p[0].start_char == 0 and p[-1].end_char == len(text)
    assert {r.cut_kind for r in by["b"][:-1]} == {"forced"} and by["b"][0].cut_run == 1000
    assert "forced" not in {r.cut_kind for r in by["a"]}


def test_strongest_cut():
    s = np.array([RNG.randint(0, 5) for _ in range(500)], np.int8)
    index = splitting.StrongestCut(s, 0, 500, 128)
    for _ in range(300):
        a = RNG.randint(0, 490)
        b = min(499, a + RNG.randint(0, 127))
        best = max(range(a, b + 1), key=lambda i: (s[i], i))
        assert index.query(a, b) == (best, s[best])


# 3 -------------------------------------------------------------------------------------

ENT = "record_id long, label string, entity_type string, description string, discovery_confidence double, evidence_count int, source_type string, discovered_at timestamp, value string, entity_id string"


def ent(i, label="A", d="a real description", c=0.5, n=1, src="web", kind="T"):
    return (i, label, kind, d, c, n, src, None, "clash", None)


def test_survivors(spark):
    rows = [
        ent(1, d="short one"), ent(2, " a\n", "the longest description", 0.9, 5), ent(2, " a\n", "the longest description", 0.9, 5), ent(3, "A", "TODO", 7.0, -1, None),
        ent(4, "B", "Als Sprachmodell kann ich leider keine Beschreibung erstellen, " * 3, float("nan"), None), ent(5, "b", "B", 0.1, 0),
        ent(6, "C", None, None, None, None, None), ent(7, None, None, None, None, None, None), ent(8, "D", "same text", 0.5, 1), ent(9, "D", "same text", 0.5, 1), ent(10, "E", "x" * 100_000),
    ]
    d = spark.createDataFrame(rows, ENT)
    s = {r.label: r for r in survivors.survivors(d).collect()}
    a = next(r for r in s.values() if r.description == "the longest description")
    assert (a.record_id, a.discovery_confidence, a.evidence_count, a.grouped) == (2, 0.9, 5, True)
    b = next(r for k, r in s.items() if k and k.lower() == "b")
    assert b.description is None and b.record_id is None and b.discovery_confidence == 0.1
    assert s["D"].record_id is None and s["D"].grouped and not s["E"].grouped
    assert survivors.survivors(d.limit(0)).count() == 0
    q = survivors.source_quality(d).collect()
    assert all(0 < r.sensitivity < 1 and 0 < r.specificity < 1 for r in q)


def test_two_sided_model_finds_the_bad_source(spark):
    """A source whose values are mostly impossible has a lower specificity."""
    rows = [ent(i * 3 + k, f"L{i}", f"description {i}" if k < 2 else "n/a", 0.5, 1, ("good", "fair", "bad")[k]) for i in range(80) for k in range(3)]
    q = {r.source: r.specificity for r in survivors.source_quality(spark.createDataFrame(rows, ENT)).where("field = 'description'").collect()}
    assert q["bad"] < q["good"] and q["bad"] < q["fair"]


def test_posteriors_decide_survivors(spark):
    """A source that the others contradict everywhere loses, though its values are the most
    complete; without the others its values survive."""
    rows = [ent(i * 4 + k, f"L{i}", f"description of {i}" if k < 3 else f"a much longer but invented description {i}", 0.5 if k < 3 else 0.99, 1 if k < 3 else 90, ("a", "b", "c", "liar")[k]) for i in range(60) for k in range(4)]
    s = survivors.survivors(spark.createDataFrame(rows, ENT)).collect()
    assert len(s) == 60 and all(r.description.startswith("description of") and r.discovery_confidence == 0.5 and r.evidence_count == 1 and r.record_id is None for r in s)
    alone = survivors.survivors(spark.createDataFrame([r for r in rows if r[6] in ("a", "liar")], ENT)).collect()
    assert all(r.evidence_count == 90 and r.record_id % 4 == 3 for r in alone)


# 4 -------------------------------------------------------------------------------------


def vectors(n=1500, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 64))
    for i in range(0, n - 1, 7):
        x[i + 1] = x[i] + r.standard_normal(64) * RNG.choice([0.05, 0.1, 0.2, 0.3])
    x[5] = x[4]
    return x


def test_similar_pairs(spark):
    x = vectors()
    bad = [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 64), (9004, [0.0] * 64), (9005, [None] * 64), (None, [1.0] * 64), (9006, [float("inf")] + [1.0] * 63)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist())] + bad, "record_id long, e array<float>").withColumn("id", F.lit("clash"))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    want = set(zip(i.tolist(), j.tolist()))
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(d, "record_id", "e").collect()}
    assert got <= want | {(a, b) for a, b in got if u[a] @ u[b] >= 0.9499999}
    assert len(got & want) >= 0.97 * len(want) and (4, 5) in got
    assert neighbours.similar_pairs(d.limit(0), "record_id", "e").count() == 0


def test_top_k(spark):
    x = vectors(400)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "record_id long, e array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in neighbours.top_k(d, "record_id", "e", k=10, query_block=8, row_block=100).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == set(range(0, 400, 20))
    assert all(got[q] == set(np.argsort(-s[q])[:10].tolist()) for q in got)


# 5 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1])
def test_groups(spark, seed):
    r = random.Random(seed)
    e = [(f"n{r.randint(0, 300)}", f"n{r.randint(0, 300)}") for _ in range(220)] + [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(100)] + [(None, "q"), ("s", "s"), ("p3", "p2")]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in e:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    d = spark.createDataFrame(e, "src string, dst string").withColumn("label", F.lit("clash"))
    assert {r.node: r.group_id for r in components.link_groups(d).collect()} == {k: find(k) for k in list(up)}
    assert components.link_groups(d.limit(0)).count() == 0


def test_candidate_edges(spark):
    rows = [(["A", " a "], 0.9), (["A", "b", None], 0.85), (["c", "d"], float("nan")), (["e", "f"], None), (None, 0.9), ([], 0.9), (["g", "h", "I"], 0.99), (["j", "k"], 0.8)]
    got = {tuple(r) for r in components.candidate_edges(spark.createDataFrame(rows, "ids array<string>, score double")).collect()}
    assert got == {("a", "b"), ("g", "h"), ("g", "i")}


# 7 -------------------------------------------------------------------------------------


def test_name_parts():
    assert name_parts.person("Dr.-Ing. Uli  Müller") == name_parts.person("Mueller, Ulrich") == ("ulrich", "u", "mueller")
    assert name_parts.person("U. Mue11er") == ("", "u", "mueller")
    assert name_parts.organisation("KKW Barheim GmbH & Co. KG") == name_parts.organisation("Barheim-Kernkraftwerk GMBH&CO.KG") == ("kernkraftwerk", "gmbhcokg", "barheim")
    assert name_parts.organisation("Inst. f. Reaktorsich. Barheim Gesellschaft mit beschränkter Haftung") == ("institut+reaktorsicherheit", "gmbh", "barheim")
    assert name_parts.osa("abcd", "abdc", 2) == 1 and name_parts.osa("abcd", "axyd", 1) == 2


def test_names(spark):
    groups = [
        [("P", "Veronika Trepzubumeyer"), ("P", "VERONIKA B. TREPZUBUMEYER"), ("P", "Trepzubumeyer, Vroni"), ("P", "Dr. V. Trepzubumeier"), ("P", "Veronika Trepzbumeyer")],
        [("P", "Walter Trepzubumeyer")],
        [("O", "Messstelle Quanbakkaried GmbH & Co. KG"), ("O", "Quanbakkaried-Messst. GmbH & Co. KG"), ("O", "Quanbakkaried, Messstelle")],
        [("O", "Stadtwerke Quanbakkaried AG")],
        [("P", "Ludwig Ankbakgiskötter"), ("P", "L. Ankbakgiskoetter")],
        [("P", "Theodora Ankbakgiskötter")],
    ]
    rows = [(f"k{i}_{j}", *n) for i, g in enumerate(groups) for j, n in enumerate(g)] + [("k0_0", "P", "Veronika Trepzubumeyer"), ("x1", "P", None), ("x2", "P", "  "), (None, "P", "A B"), ("x3", "O", "x" * 3000)]
    d = spark.createDataFrame(rows, "key string, kind string, text string").withColumn("pid", F.lit("clash"))
    got = {}
    for r in names.link_names(d).collect():
        got.setdefault(r.group_id, set()).add(r.key)
    want = {frozenset(f"k{i}_{j}" for j in range(len(g))) for i, g in enumerate(groups)} | {frozenset({"x3"})}
    assert {frozenset(v) for v in got.values()} == want
    pairs = {tuple(r) for r in names.linked_pairs(names.link_names(d)).collect()}
    assert len(pairs) == 10 + 3 + 1 and all(a < b for a, b in pairs)
    assert names.link_names(d.limit(0)).count() == 0


def test_names_three_and_four_edits_apart(spark):
    rows = [("a1", "P", "Theodora Ankbakgiskoetter"), ("a2", "P", "Theodora Onkbokgoskoettor"), ("b1", "O", "Stadtwerke Quanbakkaried AG"), ("b2", "O", "Stadtwerke Quonbokkoried AG"), ("c1", "P", "Walter " + "Vodwiduzian" * 3), ("c2", "P", "Walter " + "Vodwiduzian" * 2 + "Vudwuduzuun"), ("d1", "P", "Theodora Ankbakzumeyer")]
    d = spark.createDataFrame(rows, "key string, kind string, text string")
    assert {tuple(r) for r in names.linked_pairs(names.link_names(d)).collect()} == {("a1", "a2"), ("b1", "b2"), ("c1", "c2")}


def test_names_outside_the_lists(spark):
    """Family name first, nicknames, kinds of organisation and initials that no list has."""
    rows = [
        ("a1", "P", "Gruberreich Hans"), ("a2", "P", "Hans Gruberreich"), ("b1", "P", "Bob Fitzwarren"), ("b2", "P", "Robert Fitzwarren"), ("c1", "O", "Quanbakan Analytics Guild Inc"), ("c2", "O", "Quanbakan Analytcs Guild Inc."),
        ("d1", "O", "Zentral Odonto Kollegium Upsala AG"), ("d2", "O", "ZOKU AG"), ("e1", "P", "Xiaoming Quarterflash"), ("e2", "P", "Quarterflash Xiaoming"), ("f1", "P", "Иван Петрович"), ("f2", "P", "ИВАН ПЕТРОВИЧ"), ("g1", "O", "Depot 1041 AG"), ("g2", "O", "Depot 1042 AG"),
    ]
    d = spark.createDataFrame(rows, "key string, kind string, text string")
    assert {tuple(r) for r in names.linked_pairs(names.link_names(d)).collect()} == {(f"{x}1", f"{x}2") for x in "abcdef"}


def test_kinds_are_learned(spark):
    """A word that many names share is a kind, abbreviations of it are read, and it doesn't link."""
    rows = [(f"k{i}", "O", f"Zunfthaus {a}{b}heim") for i, (a, b) in enumerate((a, b) for a in ("Kor", "Blim", "Vaster", "Ost") for b in ("ta", "nelu", "gabo"))] + [("x1", "O", "Zunfth. Blimnelheim"), ("x2", "O", "Gildenstube Blimneluheim")]
    d = spark.createDataFrame(rows, "key string, kind string, text string")
    kinds, _ = names.common_words(d)
    assert "zunfthaus" in kinds and name_parts.organisation("Zunfth. Blimnelheim", kinds) == ("zunfthaus", "", "blimnelheim")
    assert ("k4", "x1") in {tuple(r) for r in names.linked_pairs(names.link_names(d)).collect()}


def test_usual_names_are_not_errors():
    """A spelling made of usual letters is a name of its own, an unusual one an error."""
    made = [a + b + c for a in ("ank", "bar", "dro", "fen", "gli", "hus") for b in ("kom", "pel", "sta", "tro", "vis") for c in ("moeller", "berg", "thal", "huber")]
    n = {}
    for w in made:
        for t in name_parts.fours(w).tolist():
            n[t] = n.get(t, 0) + 1
    s = name_parts.Spelling(n)
    odds = lambda x, y, d, k=1: name_parts.mistyped(k, d, len(x), s.usual([x], [y])[0])
    many = s.usual(made + ["a" * 300], made[1:] + ["bqrpxlhuber", made[0]])  # alone or together
    assert all(abs(many[i] - s.usual([x], [y])[0]) < 1e-9 for i, (x, y) in enumerate(zip(made + ["a" * 300], made[1:] + ["bqrpxlhuber", made[0]])))
    assert odds("barpelhuber", "fenpelhuber", 2) < 0 < odds("bqrpxlhuber", "barpelhuber", 2) and odds("bqrpxlhuber", "barpelhuber", 2, 3) < 0


def test_hot_group_of_names(spark):
    rows = [(f"k{i:03d}", "P", "Veronika Trepzubumeyer") for i in range(60)] + [(f"o{i:03d}", "P", f"Walter {chr(97 + i % 26) * 7}{chr(97 + i // 26) * 4}") for i in range(60)]
    d = spark.createDataFrame(rows, "key string, kind string, text string")
    assert names.linked_pairs(names.link_names(d)).count() == 60 * 59 // 2


def test_edit_keys_and_edits_of_many():
    rng = random.Random(9)
    for _ in range(2000):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + 2] = rng.choice([b[i : i + 2][::-1], b[i : i + 1], ["h"], [*b[i : i + 2], "a"]])
        b = "".join(b) or "a"
        limit = min(4, max(1, min(len(a), len(b)) // 3))
        edits = name_parts.osa(a, b, limit)
        assert min(name_parts.osa_all([a], [b], np.array([limit]))[0], limit + 1) == edits
        assert edits > limit or set(name_parts.edit_keys(a, 4)) & set(name_parts.edit_keys(b, 4))


# 8 -------------------------------------------------------------------------------------


def check_packing(rows, sizes, cap):
    used, got = {}, {}
    for r in rows:
        if r.container_id is not None:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(sizes)
    for k, n in sizes.items():
        assert sum(r.n_tokens for r in got[k]) == n
        assert len(got[k]) == 1 or n > cap
        assert (got[k][0].container_id is None) == (n == 0)
    assert all(v <= cap for v in used.values()) and set(used) == set(range(len(used)))
    return len(used)


@pytest.mark.parametrize("bucket_rows", [50, 10_000])
def test_packing(spark, bucket_rows):
    sizes = {i: min(2600, int(RNG.lognormvariate(5, 1.2))) for i in range(3000)} | {5000: 0, 5001: 512, 5002: 513, 5003: 51200}
    items = spark.createDataFrame([(k, v, "c") for k, v in sizes.items()], "doc_id long, n_tokens long, rank string")
    caps = spark.createDataFrame([(1, "a", 512), (2, "b", 8192), (2, "b", 8192), (3, "c", None)], "profile_id int, profile_name string, capacity_tokens int")
    p = packing.pack(items, caps, bucket_rows=bucket_rows).collect()
    total = sum(sizes.values())
    for pid, cap in ((1, 512), (2, 8192)):
        n = check_packing([r for r in p if r.profile_id == pid], sizes, cap)
        assert n <= 1.05 * total / cap + 2
    assert packing.pack(items.limit(0), caps).count() == 0 and packing.pack(items, caps.limit(0)).count() == 0


def test_configurations_beat_pairs():
    """Sizes of which best fit decreasing alone wastes room: 6/13 and 4/13 and 3/13."""
    lengths, counts = np.array([60, 40, 30]), np.array([300, 300, 300])
    rows = packing.plan_containers(lengths, counts, 130)
    assert max(first + (b - a + each - 1) // each for _, a, b, first, each in rows) <= 305


# 9 -------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(i, s, RNG.randint(50, 400), "c") for i, s in enumerate(["big"] * 3000 + ["mid"] * 500 + ["tiny"] * 40 + ["other"] * 20)] + [(9000, None, 10, "c"), (9001, "mid", 0, "c"), (9002, "mid", None, "c")]
    d = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, share string")
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 3), ("tiny", 0.1, 4), ("absent", 0.2, 2), ("mid", 0.3, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    for rows_per in (100, 20_000):
        sel, rep = mixing.mix(d, t, bucket_rows=rows_per)
        r = {x.source: x for x in rep.collect()}
        assert r["absent"].actual_share == 0 and set(r) == {"big", "mid", "tiny", "absent"}
        for s, share in (("big", 0.5), ("mid", 0.375), ("tiny", 0.125)):
            assert r[s].planned_share == pytest.approx(share) and r[s].actual_share == pytest.approx(share, abs=0.01)
        most = {x.source: x.m for x in sel.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m")).collect()}
        assert most["big"] <= 1 and most["mid"] <= 3 and most["tiny"] == 4
        assert sel.where("doc_id >= 9000").count() == 0
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[0].count() == 0


def test_temperature():
    q = np.array([0.7, 0.2, 0.1, 0.0])
    assert mixing.tempered(q, 0).tolist() == pytest.approx([1 / 3, 1 / 3, 1 / 3, 0]) and mixing.tempered(q, 1).tolist() == pytest.approx(q.tolist())
    x = mixing.exponent_for_entropy(q, 0.95)
    assert mixing.entropy(mixing.tempered(q, x)) == pytest.approx(0.95, abs=1e-6)
    m = mixing.solve(["a", "b"], np.array([900.0, 100.0]), np.array([0.5, 0.5]), np.array([1.0, 2.0]), budget=800)
    assert m.exponent < 1 and m.budget == pytest.approx(800) and m.budget * m.weights[1] <= 200 + 1e-6 and m.budget * m.weights[0] <= 900


# 10 ------------------------------------------------------------------------------------

SENTENCES = {
    "de": ["Die Behörde hat den Antrag des Betreibers nach langer Prüfung genehmigt.", "Der Gutachter weist darauf hin, dass die Anlage nicht in Betrieb ist."],
    "en": ["The authority has approved the request of the operator after a long review.", "The inspector noted that the plant is not in operation at the moment."],
    "fr": ["L'autorité a approuvé la demande de l'exploitant après un long examen.", "L'expert signale que l'installation n'est pas en service pour le moment."],
    "es": ["La autoridad ha aprobado la solicitud del titular después de un largo examen.", "El inspector señala que la instalación no está en servicio por ahora."],
    "nl": ["De autoriteit heeft het verzoek van de exploitant na lang onderzoek goedgekeurd.", "De deskundige merkt op dat de installatie nu niet in bedrijf is."],
    "it": ["L'autorità ha approvato la domanda del gestore dopo un lungo esame.", "L'esperto fa notare che l'impianto al momento non è in servizio."],
}


def test_language_of_short_sentences_and_suffixes(spark):
    """Short whole sentences count, lists of codes don't; of rows with one key the same one is
    taken in any order; an address suffix tells where the text hardly does."""
    rows = [(i, " ".join(SENTENCES[("de", "en")[i % 2]]), ("de", "en")[i % 2], "s", "d", ("at", "uk")[i % 2]) for i in range(60)]
    extra = [(900, "Das ist nicht gut. Wir sind noch da.", None, "s", "d", None), (901, "A-12 B-13. C-14 D-15.", None, "s", "d", None), (902, SENTENCES["de"][0], None, "s", "d", None), (902, SENTENCES["en"][0], None, "s", "d", None)]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, dossier string, tld string")
    got = {r.doc_id: r for r in language.identify(d, suffix="tld").where("doc_id >= 900").collect()}
    assert got[900].lang_found == "de" and got[901].lang_found is None
    again = {r.doc_id: r for r in language.identify(d.orderBy(F.col("text").desc()), suffix="tld").where("doc_id >= 900").collect()}
    assert got[902].lang_found == again[902].lang_found


def test_language(spark):
    docs = [(len(SENTENCES) * i + k, " ".join(RNG.choices(s, k=3)), c if i % 5 else None, "src", "dos") for i in range(30) for k, (c, s) in enumerate(SENTENCES.items())]
    en, de = SENTENCES["en"][0], SENTENCES["de"][1]
    extra = [(1001, f"{en} {de} {en}", "en"), (1002, en, "de"), (1003, "", "en"), (1004, None, None), (1005, "KTA-12 0.4 7\nJAA-99 1.2 3", "en"), (1006, f'{en} The German term "die Genehmigung der Behörde" is kept.', "en"), (1007, de.upper(), "DE"), (1008, de.replace("darauf", "dar-\nauf") + "\n", "xx"), (1009, (en + "\n") * 3000, None)]
    d = spark.createDataFrame(docs + [(*x, None, None) for x in extra] + [(1001, extra[0][1], "en", None, None), (None, en, "en", None, None)], "doc_id long, text string, lang string, source string, dossier string").withColumn("prior", F.lit(1))
    got = {}
    for r in language.identify(d).collect():
        assert 0 <= r.confidence <= 1
        got.setdefault(r.doc_id, []).append(r.lang_found)
    for i, t, c, *_ in docs:
        assert set(got[i]) == {list(SENTENCES)[i % 6]}, t
    assert sorted(got[1001]) == ["de", "en", "en"] and got[1002] == ["en"] and got[1003] == got[1004] == got[1005] == [None] and got[1006] == ["en"] and got[1007] == ["de"] and got[1008] == ["de"] and got[1009] == ["en"]
    assert None not in got and language.identify(d.limit(0)).count() == 0


def test_sentences_with_abbreviations(spark):
    t = 'Der Begriff "safe enclosure" wird in § 147 Abs. 4 Nr. 4 nicht verwendet.'
    assert language.segments(t) == [(0, len(t))]
    two = "Das ist von dieser Art. Die Anlage steht."
    assert [two[a:e] for a, e in language.segments(two)] == ["Das ist von dieser Art.", "Die Anlage steht."]
    assert language.goes_on("A b: C d. E\nF:\nG", language.segments("A b: C d. E\nF:\nG")) == [False, True, False, False, False]
    docs = [(len(SENTENCES) * i + k, " ".join(RNG.choices(s, k=3)), c, "src", "dos") for i in range(30) for k, (c, s) in enumerate(SENTENCES.items())]
    d = spark.createDataFrame([*docs, (1001, t, None, "src", "dos")], "doc_id long, text string, lang string, source string, dossier string")
    assert [r.lang_found for r in language.identify(d).where("doc_id = 1001").collect()] == ["de"]


def test_declared(spark):
    d = spark.createDataFrame([("de-DE",), ("Deutsch",), ("EN",), ("xx",), ("",), (None,)], "lang string")
    assert [r[0] for r in d.select(language.declared(F.col("lang"))).collect()] == ["de", "de", "en", None, None, None]


# tokens --------------------------------------------------------------------------------


def test_token_counts_are_exact(spark):
    enc = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    texts = ["", None, " ", "a  b", "a\n b \n\nc", "it's 12,5 µSv/h — ok", " lead", "trail ", "x\ty  z", "😀 ä", "w " * 500 + "w"] + ["".join(RNG.choice(" ab1.\nä'") for _ in range(RNG.randint(1, 60))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.k: r.n_tokens for r in tokens.with_token_count(d, ["k"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_mixing_bisects():
    """Without a budget the exponent is found by bisection, and every share meets its target."""
    share, tokens = np.array([0.5, 0.3, 0.2]), np.array([9000.0, 500.0, 100.0])
    m = mixing.solve(list("abc"), tokens, share, np.array([1.0, 2.0, 3.0]))
    assert 0.99 < m.exponent < 1 and np.abs(m.weights - share).max() <= 3e-7 and mixing.divergence(share, m.weights) <= mixing.MOST_DIVERGENCE
    assert mixing.divergence(share, mixing.tempered(tokens / tokens.sum(), m.exponent - 1e-6, share)) > mixing.MOST_DIVERGENCE
    assert (m.budget * m.weights <= tokens * np.array([1.0, 2.0, 3.0]) * (1 + 1e-9)).all()
    same = mixing.solve(["a", "b"], np.array([50.0, 50.0]), np.array([0.5, 0.5]), np.array([1.0, 1.0]))
    assert same.exponent == 0 and same.budget == 100
