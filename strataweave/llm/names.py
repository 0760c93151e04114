"""Variant spellings of names typed by people."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.components import link_groups
from strataweave.llm.name_parts import KIND_WORDS, LONG, Spelling, edit_keys, end_keys, fold, fours, given_alike, hash_text, initials, is_given, is_short_for, mistyped, name_words, organisation, osa, osa_all, person
from strataweave.plans.lineage import Stage, write_stage
from strataweave.plans.skew import join_spread, join_unique

PERSON, ORGANISATION = "P", "O"
#: A word is one of a kind of organisation, or a given name, if at least so many different names
#: have it, and this share of all: so there are at most 1/COMMON_SHARE words a name.
COMMON_NAMES, COMMON_SHARE = 8, 1 / 500
#: Letters of the shorter core for each edit that two spellings of a name may be apart.
LETTERS_AN_EDIT = 4


def common_words(records: DataFrame) -> tuple[tuple[str, ...], frozenset[str]]:
    """(words of kinds of organisation, given names) as the names themselves have them: words that
    many different names share, for persons as their first word. Bounded by COMMON_SHARE."""
    names = records.select("kind", "text").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for kind, text in zip(x["kind"], x["text"]):
                if kind == ORGANISATION:
                    out += [(kind, w, text) for w in {w for w, cut in name_words(text)[0] if not cut}]
                else:
                    words = fold(text).rpartition(",")[2].split()
                    out += [(kind, w, text) for w in words[:-1] if w.isalpha()][:1] if "," not in text else [(kind, w, text) for w in words if w.isalpha()][:1]
            yield pd.DataFrame([(k, w) for k, w, _ in out], columns=["kind", "word"])

    n = {r["kind"]: r["count"] for r in names.groupBy("kind").count().collect()}  # two kinds
    least = F.lit(None)
    for k, m in n.items():
        least = F.when(F.col("kind") == k, max(COMMON_NAMES, math.ceil(COMMON_SHARE * m))).otherwise(least)
    words = names.where("text is not null").mapInPandas(run, "kind string, word string").groupBy("kind", "word").count()
    found = words.where(F.col("count") >= least).orderBy(F.desc("count"), "word").collect()  # at most 1/COMMON_SHARE words a name
    learned = [r["word"] for r in found if r["kind"] == ORGANISATION]
    # what shortens another kind is read as that kind
    learned = [w for w in learned if len(w) > 4 or not any(is_short_for(w, k) for k in learned)]
    kinds = dict.fromkeys([*KIND_WORDS[:3], *learned, *KIND_WORDS])
    return tuple(kinds), frozenset(r["word"] for r in found if r["kind"] == PERSON)


def profiles(records: DataFrame, kinds: tuple[str, ...] = KIND_WORDS, givens: frozenset[str] = frozenset()) -> DataFrame:
    """(key, pid, kind, a, b, core, ini) of records (key, kind, text): for persons a is the given
    name and b the initial, for organisations a is the kind and b the legal form; core is
    the family or proper name, ini an organisation's initials. Names without a core are
    left out. A name of two words of which neither is known as a given name has a second
    row with them the other way round."""

    def parts(kind: str, text: str) -> list[tuple[str, str, str, str]]:
        if kind == ORGANISATION:
            return [(*organisation(text, kinds), initials(text))]
        first = person(text, givens)
        words = [w for w in fold(text).split()]
        if len(words) == 2 and "," not in text and all(w.isalpha() and len(w) > 1 and not is_given(w, givens) for w in words):
            return [(*first, ""), (*person(f"{words[0]}, {words[1]}", givens), "")]
        return [(*first, "")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lru_cache(maxsize=100_000)(parts)
        for x in batches:
            out = [(key, kind, *p) for key, kind, text in zip(x["key"], x["kind"], x["text"]) for p in known(kind, text) if p[2]]
            yield pd.DataFrame(out, columns=["key", "kind", "a", "b", "core", "ini"])

    p = records.select("key", "kind", "text").where("key is not null and text is not null").mapInPandas(run, "key string, kind string, a string, b string, core string, ini string")
    return p.withColumn("pid", F.sha1(F.concat_ws("|", "kind", "a", "b", "core", "ini")))


def widest(kind: str) -> int:
    """The most edits between two cores that ``compare`` takes for one name."""
    return 4 if kind == PERSON else 3


def most_edits(kind: str, shorter: int | np.ndarray) -> int | np.ndarray:
    return np.minimum(widest(kind), np.maximum(1, shorter // LETTERS_AN_EDIT))


def _number(word: str) -> str:
    return "".join(filter(str.isdigit, word))


def cores_alike(base: DataFrame) -> Stage:
    """Written (kind, core, like, d): every two cores of profiles (kind, core, n) that can be spellings of
    one, with the edits between them, either way round, and each with itself.

    ``edit_keys`` gives any two within three edits (and long ones within four) a common key,
    whatever the other parts of the names are, so also parts that profiles gain by merging
    need no further blocking; four edits in words of 16 to LONG letters, which count only
    with equal given names, share one of ``end_keys`` with the given name. What shares a key is verified: its edits are counted, numbers must be equal, and one of
    the two must be rather the other typed wrong than a name of its own (``mistyped``), by
    how usual its letters are among all cores and how many records have it."""
    written = write_stage(base.groupBy("kind", "core").agg(F.sum("n").alias("n"), F.collect_set("a").alias("as")).withColumn("id", F.monotonically_increasing_id()), "cores")
    cores = written.df

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for kind, t in x.groupby("kind"):
                at, n = np.unique(np.concatenate([fours(c) for c in t["core"]]), return_counts=True)
                yield pd.DataFrame({"kind": kind, "t": at, "n": n})

    counts = cores.select("kind", "core").mapInPandas(count, "kind string, t long, n long").groupBy("kind", "t").agg(F.sum("n").alias("n"))
    usual: dict[str, dict[int, int]] = {}
    for r in counts.toLocalIterator():  # at most N_SYMBOLS to the fourth a kind
        usual.setdefault(r["kind"], {})[r["t"]] = r["n"]
    # how many names share their kind or given name with a name: what it could be mistaken for
    same = base.select("kind", "a", "core").distinct().groupBy("kind", "a").count().groupBy("kind").agg((F.sum(F.col("count").cast("double") ** 2) / F.sum("count")).alias("m"))
    chance = {r["kind"]: math.log(max(1.0, r["m"])) for r in same.collect()}  # two kinds
    shared = base.sparkSession.sparkContext.broadcast((usual, chance))  # of fixed size

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = []
                for kind, core, given in zip(*(part.column(i).to_pylist() for i in (0, 1, 3))):
                    own = [edit_keys(core, 3, kind, LETTERS_AN_EDIT)]
                    if kind == PERSON and 4 * LETTERS_AN_EDIT <= len(core) <= LONG + 4:
                        own += [end_keys(core, 8 * hash_text(a) + 5) for a in given if a]
                    found.append(np.concatenate(own))
                ids = np.repeat(part.column(2).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(ids)], names=["block", "id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the ids of each block, from rows in the order of their blocks."""
        block, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            old = len(block)
            block, ids = np.concatenate((block, b.column(0).to_numpy())), np.concatenate((ids, b.column(1).to_numpy()))
            first = np.maximum.accumulate(np.where(np.diff(block, prepend=block[0] - 1) != 0, np.arange(len(block)), 0))
            n = np.arange(len(block)) - first  # partners before each row
            n[:old] = 0  # have met before
            ends, lo = np.cumsum(n), old
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
                k = n[lo:hi]
                if k.sum():
                    p = ids[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[lo:hi], k)]
                    q = np.repeat(ids[lo:hi], k)
                    pair = np.unique(np.stack((np.minimum(p, q), np.maximum(p, q))), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["x", "y"])
                lo = hi
            block, ids = block[first[-1] :], ids[first[-1] :]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, by_chance = shared.value
        spelled = {k: Spelling(c) for k, c in counts.items()}
        for x in batches:
            for kind, t in x.groupby("kind"):
                limit = most_edits(kind, np.minimum(t["core"].str.len(), t["like"].str.len()).to_numpy())
                d = osa_all(t["core"].tolist(), t["like"].tolist(), limit)
                t = t.assign(d=d)[d <= limit]
                c, e, d = t["core"].tolist(), t["like"].tolist(), t["d"].to_numpy()
                one, two = (mistyped(t[n].to_numpy(), d, np.array(list(map(len, x))), spelled[kind].usual(x, y)) for n, x, y in (("n", c, e), ("m", e, c)))
                ok = (np.maximum(one, two) >= by_chance[kind]) & np.array([_number(x) == _number(y) for x, y in zip(c, e)], bool)
                yield t.loc[ok, ["kind", "core", "like", "d"]]

    parts = int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = cores.select("kind", "core", "id", "as").repartition(parts).mapInArrow(keys, "block long, id long")
    two = keyed.repartition("block").sortWithinPartitions("block").mapInArrow(meet, "x long, y long").distinct()
    named = two.join(cores.select(F.col("id").alias("x"), "kind", "core", "n"), "x").join(cores.select(F.col("id").alias("y"), F.col("kind").alias("kind2"), F.col("core").alias("like"), F.col("n").alias("m")), "y").where("kind = kind2")
    # the work per pair is large against its bytes, which is all that adaptive partitioning sees
    found = write_stage(named.select("kind", "core", "like", "n", "m").repartition(parts).mapInPandas(verify, "kind string, core string, like string, d int"), "alike")
    one = found.df
    out = write_stage(one.unionByName(one.select("kind", F.col("like").alias("core"), F.col("core").alias("like"), "d")).unionByName(cores.select("kind", "core", F.col("core").alias("like"), F.lit(0).alias("d"))), "alike")
    for stage in (written, found):
        stage.drop()
    return out


def parts_alike(kind: str, a1, b1, a2, b2) -> tuple[int, int]:
    """(strength, most edits between the cores). 0: the names differ. 1: they match only if nothing
    better does, as one of them lacks what would tell (an initial for a given name, no legal
    form, no kind). 2: they match."""
    if kind == PERSON:
        if len(a1) and len(a2):
            g = min(given_alike(x, y) for x in a1 for y in a2)
            return (0, 0) if g > 2 else (2, 4 if g == 0 else 2)
        if not set(b1) & set(b2) - {""}:
            return 0, 0
        return (2 if not len(a1) and not len(a2) else 1), 2
    f1, f2 = set(b1), set(b2)
    if len(a1) and len(a2) and not set(a1) & set(a2) or f1 and f2 and not f1 & f2:
        return 0, 0
    return (2 if bool(f1) == bool(f2) and bool(len(a1)) == bool(len(a2)) else 1), 3


def compare(kind: str, a1, b1, c1, a2, b2, c2) -> int:
    """Strength of the match of two profiles of given names or kinds a, initials or legal forms b
    and cores c (``parts_alike``), without regard to how usual their spellings are."""
    strength, most = parts_alike(kind, a1, b1, a2, b2)
    return strength if strength and any(osa(x, y, most) <= min(most, int(most_edits(kind, min(len(x), len(y))))) for x in c1 for y in c2) else 0


def link_names(records: DataFrame) -> DataFrame:
    """(key, group_id) of records (key, kind, text), where kind is P or O.

    Merge and rematch: profiles that match are merged, a merged profile has the union of
    spellings, given names, initials, kinds and legal forms of its parts, and what was merged
    meets all others again, until a round merges nothing. In the first round only full
    matches merge; then a profile that lacks the telling part joins the one best of the
    richer profiles, so it can't chain two of them; an organisation's initials join the
    name they are of in the same way. Null or blank names and null keys are left out;
    equal names link; repeated rows count once; no records give no rows. Extra columns are
    not read.
    """
    kinds, givens = common_words(records)
    recs = write_stage(profiles(records, kinds, givens).distinct(), "names").df
    base = write_stage(recs.groupBy("pid").agg(*(F.first(c).alias(c) for c in ("kind", "a", "b", "core", "ini")), F.count(F.lit(1)).alias("n")), "profiles")
    profiles_, base = base, base.df
    alike = cores_alike(base)
    # a record that can be read two ways holds its profiles together
    two_ways = recs.groupBy("key").agg(F.min("pid").alias("src"), F.max("pid").alias("dst")).where("src < dst").select("src", "dst")
    assign = write_stage(base.select("pid", F.col("pid").alias("cid"), F.lit(True).alias("moved")), "assign")
    first = True
    while True:
        member = base.join(assign.df, "pid")
        some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
        rich = write_stage(member.groupBy("cid").agg(F.first("kind").alias("kind"), some("a").alias("a"), some("b").alias("b"), some("core").alias("c"), some("ini").alias("i"), F.sum("n").alias("n"), F.max("moved").alias("moved")), "rich")
        held = rich.df.select("cid", "kind", "moved", F.explode("c").alias("core"))
        again = held.where("moved").select(F.col("cid").alias("p"), "kind", "core")
        near = again.join(alike.df, ["kind", "core"]).select("p", "kind", F.col("like").alias("core"), "d")
        near = near.join(held.select(F.col("cid").alias("q"), "kind", "core"), ["kind", "core"]).select("p", "q", "d")
        short = held.where("kind = 'O' and length(core) between 2 and 8").select(F.col("cid").alias("p"), F.col("core").alias("ini"))
        by_initials = short.join(rich.df.select(F.col("cid").alias("q"), F.explode("i").alias("ini")), "ini").select("p", "q", F.lit(-1).alias("d"))
        cp = near.unionByName(by_initials).where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "d").groupBy("x", "y").agg(F.min(F.when(F.col("d") >= 0, F.col("d"))).alias("d"))
        side = lambda s: rich.df.select(F.col("cid").alias(s), *(F.col(c).alias(c + s) for c in ("kind", "a", "b", "n")))
        both = cp.join(side("x"), "x").join(side("y"), "y")

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in batches:
                out = []
                for x, y, d, k, k2, ax, bx, nx, ay, by, ny in zip(*(t[c] for c in ("x", "y", "d", "kindx", "kindy", "ax", "bx", "nx", "ay", "by", "ny"))):
                    s, most = parts_alike(k, ax, bx, ay, by) if k == k2 else (0, 0)
                    if d != d:  # initials and the name they are of
                        s, d, most = (1 if k == k2 and not (len(bx) and len(by) and not set(bx) & set(by)) else 0), 0, 0
                    if s and d <= most:
                        lacks = len(ax) + len(bx) < len(ay) + len(by) or len(ax) + len(bx) == len(ay) + len(by) and nx < ny
                        out.append((x, y, s, int(d), lacks if k == ORGANISATION else not len(ax), nx, ny))
                yield pd.DataFrame(out, columns=["x", "y", "s", "d", "wx", "nx", "ny"])

        scored = write_stage(both.mapInPandas(judge, "x string, y string, s int, d int, wx boolean, nx long, ny long"), "scored")
        edges = scored.df.where("s = 2").select(F.col("x").alias("src"), F.col("y").alias("dst"))
        if first:
            edges = edges.unionByName(two_ways)
        else:
            weak = scored.df.where("s = 1").select(F.when(F.col("wx"), F.col("x")).otherwise(F.col("y")).alias("src"), F.when(F.col("wx"), F.col("y")).otherwise(F.col("x")).alias("dst"), "d", F.when(F.col("wx"), F.col("ny")).otherwise(F.col("nx")).alias("n"))
            best = weak.groupBy("src").agg(F.min(F.struct("d", (-F.col("n")).alias("n"), "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"))
            edges = edges.unionByName(best)
        merged = not edges.isEmpty()
        if merged or first:  # after the first round all meet again, as weak matches count from then on
            g = link_groups(edges)
            joined = join_unique(assign.df.select("pid", "cid"), g.select(F.col("node").alias("cid"), F.col("group_id").alias("to")), "cid", "left")
            new = write_stage(joined.select("pid", F.coalesce("to", "cid").alias("cid"), (F.lit(first) | F.col("to").isNotNull()).alias("moved")), "assign")
            assign.drop()
            assign = new
        for s in (rich, scored):
            s.drop()
        if not merged and not first:
            break
        first = False
    for stage in (alike, profiles_):
        stage.drop()
    return join_unique(recs.select("key", "pid"), assign.df.select("pid", F.col("cid").alias("group_id")), "pid").select("key", "group_id").distinct()


def linked_pairs(groups: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of the records of each group; a group with a large share of
    the records is spread over tasks."""
    a, b = groups.select("group_id", F.col("key").alias("key_a")), groups.select("group_id", F.col("key").alias("key_b"))
    return join_spread(a, b, "group_id").where("key_a < key_b").select("key_a", "key_b")
