"""Mapping freely typed values to a canonical list."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.name_parts import fold, osa
from strataweave.plans.lineage import write_stage
from strataweave.plans.skew import join_unique

#: Jaccard similarity of the token sets from which a list entry is a candidate. Two letters
#: typed wrong in a word of seven leave about this.
MIN_SIMILARITY = 0.4
#: Up to so many forms the reference side of the prefix join is an index that goes to all tasks;
#: beyond, both sides are shuffled by token. Both ways give the same rows.
BROADCAST_FORMS = 100_000
#: A value cut off with a stop has at least this share of the letters of what it means.
LEAST_CUT = 0.4

# Words that carry no meaning in a label.
FILLERS = frozenset("der die das des dem den von vom of the for an a".split())
# Those looked for with a typing error between other words.
INNER_FILLERS = ("of", "for", "der")


def parts(value: str) -> list[str]:
    """The readings of a value as typed, the likeliest first: without bracketed remarks, its
    parts between semicolons, slashes and dashes, the remarks themselves, and the whole."""
    v = value.strip()
    if re.match(r"(?i)^[a-z][a-z0-9+.-]*://", v):
        v = re.split(r"[#/]", v.rstrip("#/"))[-1]
    v = re.sub(r"^[A-Za-z][\w.-]*:(?=\S)", "", v)
    bare = re.sub(r"[\[({<][^\])}>]*[\])}>]", " ", v)
    found = [bare, *re.split(r";|\s[/|–-]\s", bare), *re.findall(r"[\[({<]([^\])}>]*)[\])}>]", v), v]
    return list(dict.fromkeys(x.strip() for x in found if x.strip()))


def plain(value: str) -> tuple[str, bool]:
    """(folded words without decoration, whether the last word is cut off with a stop)."""
    v = re.sub(r"(?i)[_\s](node|class|type|entity)$", "", value.strip())
    v = re.sub(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])", " ", v) if not v.isupper() else v
    v = re.sub(r"(?<=[^\W\d_])\d+$", "", v.strip())
    cut = v.endswith(".")
    words = [w for w in re.split(r"[\W_]+", fold(v)) if w]
    inner = range(1, len(words) - 1)
    kept = [w for i, w in enumerate(words) if not (w in FILLERS or i in inner and 2 <= len(w) <= 4 and any(osa(w, f, 1) <= 1 for f in INNER_FILLERS))] or words
    return " ".join(kept), cut


def readings(value: str) -> list[tuple[str, bool]]:
    """(plain, cut) of each reading of a value, the likeliest first."""
    return list(dict.fromkeys(x for x in map(plain, parts(value)) if x[0]))


def tokens(text: str) -> list[int]:
    """Pairs of letters of a word next to each other or with one between, either way round, ends
    marked, as numbers; a pair that comes again counts as another token. Free of word order,
    and letters that changed places share most of them."""
    seen: dict[int, int] = {}
    out = []
    for w in text.split():
        m = f"^{w}$"
        for gap in (1, 2):
            for a, b in zip(m, m[gap:]):
                pair = (ord(min(a, b)) & 0xFFF) << 12 | ord(max(a, b)) & 0xFFF
                n = seen[pair] = seen.get(pair, 0) + 1
                out.append(pair << 6 | min(n, 63))
    return list(dict.fromkeys(out))


def damerau(a: str, b: str) -> int:
    """Edits between two words where an exchange may enclose further edits."""
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = {(-1, j): big for j in range(-1, len(b) + 1)} | {(i, -1): big for i in range(-1, len(a) + 1)} | {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        same = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), same
            if a[i - 1] == b[j - 1]:
                same = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def _short_vowels(t: str) -> str:
    """Written-out umlauts as one letter, so that an error in one is one error."""
    return t.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def _orders(words: list[str], typed: list[str]) -> list[tuple[str, ...]]:
    """Orders of an entry's words to compare with a typed value: all of up to three words; of
    more the given one and that in which each word stands where the typed one is nearest."""
    if len(words) <= 3:
        return list(permutations(words))
    left, order = list(words), []
    for t in typed:
        if left:
            near = min(left, key=lambda w: osa(t, w, 3))
            if osa(t, near, 3) <= 3:
                order.append(near)
                left.remove(near)
    return [tuple(words), (*order, *left)]


def edits(value: str, cut: bool, entry: str) -> int | None:
    """Typing errors between a plain value and a plain list entry in the better word order;
    None if there are more than a name of that length is typed with."""
    v = value.replace(" ", "")
    n = len(v)
    limit = 0 if n < 3 else 1 if n < 5 else 2 if n < 12 else 3
    best, vs = limit + 1, _short_vowels(v)
    for o in _orders(entry.split(), value.split()):
        e = "".join(o)
        d = osa(v, e, limit)
        if d > 0:
            es = _short_vowels(e)
            x = osa(vs, es, limit + 1)
            d = min(d, damerau(vs, es) if x == limit + 1 and abs(len(vs) - len(es)) <= limit else x)
        if cut and n >= 3 and d > 0 and LEAST_CUT * len(e) <= n < len(e):
            d = min(d, osa(v, e[:n], 1))
        best = min(best, d)
    return best if best <= limit else None


def cut_forms(entry: str) -> list[str]:
    """What a plain entry may be cut off to: its beginnings of three letters or more."""
    least = max(3, math.ceil(LEAST_CUT * len(entry.replace(" ", ""))))
    return list(dict.fromkeys(x for x in (entry[:i].strip() for i in range(3, len(entry))) if len(x.replace(" ", "")) >= least))


def _value_forms(df: DataFrame) -> DataFrame:
    """(value, place, plain, cut): the readings of each value in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [(v, i, *r) for v in x["value"] for i, r in enumerate(readings(v))]
            yield pd.DataFrame(got, columns=["value", "place", "plain", "cut"])

    return df.select("value").mapInPandas(run, "value string, place int, plain string, cut boolean")


def _entry_forms(df: DataFrame) -> DataFrame:
    """(entry_id, plain, form, cut): each plain entry, and what it may be cut off to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = []
            for k, t in zip(x["entry_id"], x["form"]):
                p = plain(t)[0]
                if p:
                    got += [(k, p, p, False), *((k, p, c, True) for c in cut_forms(p))]
            yield pd.DataFrame(got, columns=["entry_id", "plain", "form", "cut"])

    return df.mapInPandas(run, "entry_id string, plain string, form string, cut boolean").distinct()


def _with_tokens(df: DataFrame, text: str) -> DataFrame:
    @F.pandas_udf("array<int>")
    def tok(s: pd.Series) -> pd.Series:
        return s.map(lambda t: tokens(_short_vowels(t)))

    return df.withColumn("tokens", tok(text))


class PrefixIndex:
    """The reference side of the prefix join in one task: for each token, in the order of rarity, the
    forms that have it in their prefix and the forms that have it at all."""

    def __init__(self, forms: pd.DataFrame, rank: dict[int, int], t: float):
        self.forms, self.rank, self.t = forms, rank, t
        sets = [np.sort([rank[x] for x in ts]) for ts in forms["tokens"]]
        self.m = np.array([len(x) for x in sets], np.int64)
        self.pre = self._postings([x[: self.prefix(len(x))] for x in sets])
        self.all = self._postings(sets)

    def prefix(self, m: int) -> int:
        return m - math.ceil(m * self.t) + 1

    def _postings(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(form, place of the token in the form) in the order of tokens, and where each token starts."""
        form = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        place = np.concatenate([np.arange(len(x)) for x in sets]) if sets else np.empty(0, np.int64)
        token = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order = np.argsort(token, kind="stable")
        return form[order], place[order], np.searchsorted(token[order], np.arange(len(self.rank) + 1))

    @staticmethod
    def _take(postings: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
        """Rows of the postings of some tokens."""
        at = postings[2]
        return np.concatenate([np.arange(at[x], at[x + 1]) for x in tokens]) if len(tokens) else np.empty(0, np.int64)

    def best(self, plain: str, cut: bool, tokens: list[int]) -> tuple[int, float] | None:
        """(form, similarity) of the greatest similarity; of equals whole entries before beginnings,
        then the form that is the value, then the first."""
        m = len(tokens)
        # tokens that no form has are the rarest: they are in the prefix and match nothing
        known = np.sort([self.rank[x] for x in tokens if x in self.rank])
        ahead = min(self.prefix(m) - (m - len(known)), len(known))
        if ahead <= 0:
            return None
        rows = self._take(self.pre, known[:ahead])
        found, first = np.unique(self.pre[0][rows], return_index=True)  # the first shared token of each form
        mine = m - len(known) + np.repeat(np.arange(ahead), np.diff(self.pre[2])[known[:ahead]])[first]
        n = self.m[found]
        room = np.minimum(m - mine, n - self.pre[1][rows][first])  # shared from the first shared token on
        found = found[(n >= m * self.t) & (n <= m / self.t) & (room >= np.ceil(self.t / (1 + self.t) * (m + n) - 1e-9))]
        if not cut:
            found = found[~self.forms["cut"].to_numpy()[found]]
        if not len(found):
            return None
        both = np.bincount(self.all[0][self._take(self.all, known)], minlength=len(self.m))[found]
        j = both / (m + self.m[found] - both)
        if j.max() < self.t:
            return None
        top = found[j == j.max()]
        top = top[self.forms["cut"].to_numpy()[top] == self.forms["cut"].to_numpy()[top].min()]
        same = [f for f in top if self.forms["form"].iat[f] == plain]
        return int(same[0] if same else top[0]), float(j.max())


def _near_index(distinct: DataFrame, r: DataFrame, rarity: DataFrame, t: float) -> DataFrame:
    """(plain, cut, entry_id, entry, similarity) of the most similar form, by an index of up to
    BROADCAST_FORMS forms that goes to all tasks; only tokens of the forms are in it."""
    spark = distinct.sparkSession
    forms = r.select("entry_id", "plain", "form", "cut", "tokens").toPandas().sort_values(["cut", "entry_id", "plain", "form"], ignore_index=True)  # at most BROADCAST_FORMS
    own = r.select(F.explode("tokens").alias("t")).distinct().join(rarity, "t").select("n", "t").toPandas().sort_values(["n", "t"])  # tokens of the forms
    shared = spark.sparkContext.broadcast((forms, {int(x): i for i, x in enumerate(own["t"])}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, rank = shared.value
        index = PrefixIndex(forms, rank, t)
        for b in batches:
            out: list[tuple] = []
            for plain_, cut, tokens_ in zip(*(b.column(i).to_pylist() for i in range(3))):
                hit = index.best(plain_, cut, tokens_)
                if hit:
                    out.append((plain_, cut, forms["entry_id"].iat[hit[0]], forms["plain"].iat[hit[0]], hit[1]))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.float64()))], names=["plain", "cut", "entry_id", "entry", "similarity"])

    return distinct.select("plain", "cut", "tokens").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "plain string, cut boolean, entry_id string, entry string, similarity double")


def _near_shuffled(distinct: DataFrame, r: DataFrame, rarity: DataFrame, min_similarity: float) -> DataFrame:
    """The same as ``_near_index`` for forms of any number, by a join on tokens."""
    t = F.lit(min_similarity)
    # the work per form is large against its bytes, which is all that adaptive partitioning sees
    spread = 3 * distinct.sparkSession.sparkContext.defaultParallelism

    def prefixed(d: DataFrame, keys: list[str], side: str) -> DataFrame:
        x = d.select(*keys, F.explode("tokens").alias("t")).join(rarity, "t")
        x = x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda s: s["t"]).alias("ts")).withColumn("m", F.size("ts"))
        if side == "_v":
            x = x.repartition(spread)
        p = (F.col("m") - F.ceil(F.col("m") * t) + 1).cast("int")
        x = x.select(*keys, "m", "ts", F.posexplode(F.slice("ts", F.lit(1), p)).alias("i", "t"))
        return x.select(*(F.col(k).alias(k + side) for k in keys), *(F.col(c).alias(c + side) for c in ("m", "ts", "i")), "t")

    left, right = prefixed(distinct, ["plain", "cut"], "_v"), prefixed(r, ["entry_id", "plain", "form", "cut"], "_r")
    # beginnings meet only values that are cut off, whole entries all values
    right = right.withColumn("cut_v", F.explode(F.when(F.col("cut_r"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    need = F.ceil(t / (1 + t) * (F.col("m_v") + F.col("m_r")))
    room = F.least(F.col("m_v") - F.col("i_v"), F.col("m_r") - F.col("i_r"))  # shared from the first shared token on
    j = left.join(right, ["t", "cut_v"]).where((F.col("m_r") >= F.col("m_v") * t) & (F.col("m_r") <= F.col("m_v") / t) & (room >= need))
    j = j.where(~F.arrays_overlap(F.slice("ts_v", F.lit(1), F.col("i_v")), F.slice("ts_r", F.lit(1), F.col("i_r"))))  # both in the same order
    both = F.size(F.array_intersect("ts_v", "ts_r"))
    j = j.withColumn("similarity", both / (F.col("m_v") + F.col("m_r") - both)).where(F.col("similarity") >= t)
    best = j.groupBy("plain_v", "cut_v").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("cut_r").alias("c"), (F.col("plain_v") != F.col("form_r")).alias("o"), F.col("entry_id_r").alias("e"), F.col("plain_r").alias("p"))).alias("b"))
    return best.select(F.col("plain_v").alias("plain"), F.col("cut_v").alias("cut"), F.col("b.e").alias("entry_id"), F.col("b.p").alias("entry"), (-F.col("b.s")).alias("similarity"))


def match_list(values: DataFrame, entries: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(value, entry_id, similarity, edits) for values (value) and entries (entry_id, form).

    Set-similarity join by prefix filter: tokens are ordered by their rarity over all
    values and entries, only the rarest tokens that a pair of the wanted similarity must
    share are joined, the length and positional filters prune by the first shared token, and
    the Jaccard similarity of what is left is computed exactly. The entry of the greatest similarity
    is kept, of equals that of the likelier reading of the value, then the one whose spaces
    are in the same places, then the smaller id. An exact check of its typing errors follows;
    values that have no entry, or whose best one is off by more than a name of that length
    is typed with, have a null entry_id and are reported. A value cut off with a stop is
    compared with the beginnings of entries too. Null values are left out; blank ones have
    no entry; null forms and ids are left out; repeated rows count once; an empty list maps
    nothing. Whole values are read, of any number of words.
    """
    v = values.select("value").where("value is not null").distinct()
    read = write_stage(_value_forms(v), "values")
    refs = write_stage(_with_tokens(_entry_forms(entries.where("entry_id is not null and form is not null").select("entry_id", "form").distinct()), "form"), "entries")
    forms = write_stage(_with_tokens(read.df.select("plain", "cut").distinct(), "plain"), "forms")
    r, distinct = refs.df, forms.df
    everything = distinct.select(F.explode("tokens").alias("t")).unionAll(r.select(F.explode("tokens").alias("t")))
    rare = write_stage(everything.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "rarity")
    rarity = rare.df
    near = _near_index if r.count() <= BROADCAST_FORMS else _near_shuffled
    best = near(distinct, r, rarity, min_similarity)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["edits"] = pd.array([edits(a, c, b) for a, c, b in zip(x["plain"], x["cut"], x["entry"])], "Int32")
            yield x[x["edits"].notna()][["plain", "cut", "entry_id", "similarity", "edits"]]

    ok = write_stage(best.mapInPandas(check, "plain string, cut boolean, entry_id string, similarity double, edits int"), "near").df
    for stage in (refs, forms, rare):
        stage.drop()
    chosen = read.df.join(ok, ["plain", "cut"]).groupBy("value").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "place", "entry_id", "edits")).alias("b"))
    return v.join(chosen, "value", "left").select("value", F.col("b.entry_id").alias("entry_id"), F.round(-F.col("b.s"), 6).alias("similarity"), F.col("b.edits").alias("edits"))


def map_records(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(record_key, value, entry_id, similarity, edits) for records (record_key, value)."""
    r = records.where("value is not null").select("record_key", "value").distinct()
    m = write_stage(match_list(r, entries), "matched").df
    return join_unique(r, m, "value", "left")


def entry_forms(table: DataFrame, key: str, name: str, alternatives: str) -> DataFrame:
    """(entry_id, form) of a reference list: its names and alternative names."""
    alt = F.coalesce(F.col(alternatives), F.array().cast("array<string>"))
    return table.select(F.col(key).alias("entry_id"), F.explode(F.concat(F.array(F.col(name)), alt)).alias("form")).where("form is not null")
