"""Missing or wrong document language labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.plans.lineage import write_stage
from strataweave.plans.skew import join_unique

LANGUAGES = ("de", "en", "fr", "es", "nl", "it")
#: The classifier is fitted on at most so many labelled documents, those of least hash.
SAMPLE_DOCUMENTS = 4000
#: Buckets of hashed letter sequences.
FEATURES = 1 << 16
#: Letters a stretch needs to count as a sentence.
SENTENCE_LETTERS = 25
#: Words of a shorter stretch that counts as one too, if it ends with a stop and one language beats
#: all others in it by SWITCH_COST.
SENTENCE_WORDS = 3
#: Nats by which one language must beat another for a change of language in a text.
SWITCH_COST = 12.0
#: Pseudo-counts that tie a dossier to its source and a source to the whole.
TIE = 20.0

# Other notations of the languages.
NOTATIONS = {
    "de": "de deu ger german deutsch allemand duits tedesco alemán aleman", "en": "en eng english englisch anglais engels inglese inglés ingles", "fr": "fr fra fre french französisch franzoesisch français francais frans francese francés frances",
    "es": "es spa spanish spanisch espagnol español espanol castellano spaans spagnolo", "nl": "nl nld dut dutch niederländisch niederlaendisch nederlands néerlandais neerlandais olandese", "it": "it ita italian italienisch italien italiano italiaans",
}

_QUOTED = re.compile(r"„[^“”\"\n]{1,80}[“”\"]|«[^»\n]{1,80}»|“[^”\n]{1,80}”|\"[^\"\n]{1,80}\"")
_BREAK = re.compile(r"(?<=[a-zß-ÿ])-\n(?=[a-zß-ÿ])")
_CUT = re.compile(r"[\n\t]+|[.!?…:;]\s+(?=[\"„«“(¿¡A-ZÀ-Þ0-9])")
# Abbreviations that end no sentence before a number, and those that never do.
_NUMBERED = frozenset("abs art nr no tab anh kap abb fig sec ziff par cap vol pp p s rn bd".split())
_NEVER_LAST = frozenset("bzw ca vgl dr prof dipl cf".split())
_LAST_WORD = re.compile(r"[^\W\d_]*$")


_STOPS = np.frombuffer(b".!?", np.uint8)


def declared(lang: Column) -> Column:
    """One of LANGUAGES for any usual notation of it, else null."""
    base = F.regexp_replace(F.lower(F.trim(lang)), r"[-_].*$", "")
    out = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        out = F.when(base.isin(*names.split()), F.lit(code)).otherwise(out)
    return out


def segments(text: str) -> list[tuple[int, int]]:
    """Stretches between sentence ends and line ends, as offsets. The stop of a known
    abbreviation is no end."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if text[m.start()] == ".":
            word = _LAST_WORD.search(text, max(at, m.start() - 8), m.start())[0].lower()
            if word in _NEVER_LAST or word in _NUMBERED and text[m.end()].isdigit():
                continue
        end = m.start() if text[m.start()] in "\n\t" else m.start() + 1
        if end > at:
            out.append((at, end))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def goes_on(text: str, parts: list[tuple[int, int]]) -> list[bool]:
    """Whether each of the text's segments goes on with the sentence of the one before it: that
    one ends with a colon or semicolon in the same line."""
    return [k > 0 and text[parts[k - 1][1] - 1] in ":;" and text[parts[k - 1][1]] not in "\n\t" for k in range(len(parts))]


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def prepare(text: str) -> str:
    """Quoted terms blanked, words broken at line ends mended; offsets are kept."""
    t = text
    if "-\n" in t:
        t = _BREAK.sub("  ", t)
    if any(q in t for q in '"„«“'):
        t = _QUOTED.sub(_blank, t)
    return t


# Bytes of a text in which case, marks and digits don't matter: a table from UTF-8 bytes.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
for _b in [*range(0, 65), *range(91, 97), *range(123, 128)]:
    _LOW[_b] = 32
_LOW[39] = 39


class Model:
    """Log-likelihoods of hashed letter sequences (three and five bytes) by language."""

    def __init__(self, table: np.ndarray):
        self.table = table  # FEATURES x languages

    @staticmethod
    def features(b: np.ndarray) -> np.ndarray:
        """Two features per place of a folded byte string: of 3 and of 5 bytes ending there."""
        x = b.astype(np.uint32)
        h3 = x.copy()
        h3[1:] += x[:-1] * np.uint32(0x9E3779B1)
        h3[2:] += x[:-2] * np.uint32(0x85EBCA6B)
        h5 = h3.copy()
        h5[3:] += x[:-3] * np.uint32(0xC2B2AE35)
        h5[4:] += x[:-4] * np.uint32(0x27D4EB2F)
        mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
        return np.stack((mix(h3), mix(h5) + np.uint32(FEATURES // 2)), 1)

    def score(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums over byte ranges in ascending order; places without letters say nothing."""
        out = np.zeros((len(starts), self.table.shape[1]))
        step, first = 1 << 18, 0
        while first < len(starts):  # a stretch of ranges at a time, to stay in the cache
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + step)))
            lo, hi = int(starts[first]), int(ends[last - 1])
            x = b[max(0, lo - 4) : hi]
            f = self.features(x)[lo - max(0, lo - 4) :]
            live = np.flatnonzero(x[lo - max(0, lo - 4) :] != 32)
            w = self.table[f[live, 0]]
            w += self.table[f[live, 1]]
            total = np.zeros((len(live) + 1, w.shape[1]), np.float32)
            np.cumsum(w, axis=0, out=total[1:])
            at = np.searchsorted(live, np.concatenate((starts[first:last], ends[first:last])) - lo)
            k = last - first
            out[first:last] = total[at[k:]] - total[at[:k]]
            first = last
        return out


def fold_bytes(text: str) -> np.ndarray:
    return _LOW[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def lower_marks(text: str) -> str:
    """Lower case of letters beyond ASCII (ASCII is folded by the byte table)."""
    if text.isascii():
        return text
    low = text.lower()
    return low if len(low) == len(text) else text


def estimate(count: np.ndarray) -> Model:
    """The model of counts of FEATURES by language."""
    half, table = FEATURES // 2, np.zeros(count.shape)
    for lo in (0, half):
        x = count[lo : lo + half] + 0.3
        table[lo : lo + half] = np.log(x / x.sum(0))
    table -= table.mean(1, keepdims=True)
    table[count.sum(1) == 0] = 0.0
    return Model(np.clip(table * 0.5, -4, 4).astype(np.float32))


def counts_of(texts: list[str], labels: list[int], model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature * languages + language, count) over the segments of some labelled texts. With a
    ``model`` each segment is relabelled by it, its document's label a weak prior, and only
    clear ones count."""
    n, out = len(LANGUAGES), np.zeros(0, np.int64)
    bufs, lens, doc = [], [], []
    for t, y in zip(texts, labels):
        p = lower_marks(prepare(t))
        for s, e in segments(p):
            b = fold_bytes(p[s:e])
            if (b != 32).sum() >= SENTENCE_LETTERS:
                bufs.append(b)
                lens.append(len(b))
                doc.append(y)
    if not bufs:
        return out, out
    b, lens, doc = np.concatenate(bufs), np.array(lens), np.array(doc)
    ends = np.cumsum(lens)
    lab = doc
    if model is not None:
        s = model.score(b, ends - lens, ends)
        s[np.arange(len(s)), doc] += 2.0
        top = np.sort(s, 1)
        lab = np.where(top[:, -1] - top[:, -2] > 6.0, s.argmax(1), -1)
    place = np.repeat(lab, lens)
    ok = np.flatnonzero((b != 32) & (place >= 0))
    f = Model.features(b)[ok].astype(np.int64) * n + place[ok, None]
    return np.unique(f, return_counts=True)


def train(docs: DataFrame, key: str, text: str, lang: str, sample: int = SAMPLE_DOCUMENTS, rounds: int = 3) -> Model:
    """Naive Bayes over segments, fitted on at most ``sample`` documents with a declared language:
    those with the least hash of their key, so the choice is the same at every run. The labels
    of whole documents are partly wrong and texts are mixed, so after the first round each
    segment is relabelled by the model. Texts stay on the executors; what comes to the driver
    is at most a number for each of FEATURES and language."""
    n = len(LANGUAGES)
    d = docs.select(F.col(key).alias("k"), declared(F.col(lang)).alias("y")).where("y is not null and k is not null")
    ids = d.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(sample).select("k")
    rows = docs.join(F.broadcast(ids), docs[key] == ids["k"], "left_semi").select(F.col(text).alias("t"), declared(F.col(lang)).alias("y")).where("t is not null and y is not null")
    parts = max(1, min(64, docs.sparkSession.sparkContext.defaultParallelism))
    part = write_stage(rows.repartition(parts), "sample")
    model: Model | None = None
    for _ in range(rounds):
        table = docs.sparkSession.sparkContext.broadcast(None if model is None else model.table)  # of fixed size

        def count(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            m = None if table.value is None else Model(table.value)
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    x = b.slice(at, 100)
                    f, c = counts_of(x.column(0).to_pylist(), [LANGUAGES.index(y) for y in x.column(1).to_pylist()], m)
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(c, pa.int64())], names=["f", "c"])

        got = part.df.mapInArrow(count, "f long, c long").groupBy("f").agg(F.sum("c").alias("c")).toArrow()
        count_all = np.zeros(FEATURES * n)
        count_all[got.column("f").to_numpy()] = got.column("c").to_numpy()
        model = estimate(count_all.reshape(FEATURES, n)) if got.num_rows else Model(np.zeros((FEATURES, n), np.float32))
    part.drop()
    return model


def viterbi(s: np.ndarray, cost: float = SWITCH_COST) -> np.ndarray:
    """Languages of consecutive segments: the best sum less ``cost`` for every change."""
    rows = s.tolist()
    best, back, every = rows[0], [], range(s.shape[1])
    for row in rows[1:]:
        top = best.index(max(best))
        least = best[top] - cost
        back.append([i if best[i] >= least else top for i in every])
        best = [(x if x >= least else least) + y for x, y in zip(best, row)]
    path = [best.index(max(best))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return np.array(path[::-1])


def likelihoods(docs: DataFrame, key: str, text: str, model: Model, keep: list[str]) -> DataFrame:
    """Per document: key, ``keep``, the log-likelihood by language of all its text (array),
    and its runs of one language: (lang index, start_char, end_char, letters, scores).

    One narrow Arrow pass over whole texts; what leaves it is small.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.table)  # FEATURES x languages, of fixed size
    slim = docs.select(F.col(key).alias("k"), *keep, F.col(text).alias("t"))
    types = {c: slim.schema[c].dataType for c in ["k", *keep]}
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in types.items()) + ", total array<double>, runs array<struct<lang:int,start_char:bigint,end_char:bigint,letters:bigint,whole:int,score:array<double>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        n = len(LANGUAGES)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                x = b.slice(part, 256)
                texts = x.column(len(keep) + 1).to_pylist()
                bufs, doc, seg, on, at = [], [], [], [], 0  # offsets are in characters of all texts of the part
                for i, t in enumerate(texts):
                    if t:
                        p = prepare(t)
                        s = segments(p)
                        doc += [i] * len(s)
                        on += goes_on(p, s)
                        seg += [(at + a, at + e, a, e) for a, e in s]
                        bufs.append(lower_marks(p))
                        at += len(p) + 1
                total = np.zeros((len(texts), n))
                owner, fields, score = np.empty(0, np.int64), [np.empty(0, np.int64)] * 5, np.empty((0, n))
                if seg:
                    raw = np.frombuffer(" ".join(bufs).encode("utf-8", "replace"), np.uint8)
                    char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    buf, c, w = _LOW[raw], np.array(seg, np.int64), np.array(doc)
                    lo, hi = char[c[:, 0]], char[c[:, 1]]
                    sc = m.score(buf, lo, hi)
                    letters = np.concatenate(([0], np.cumsum(buf != 32)))
                    nl = letters[hi] - letters[lo]
                    first = np.flatnonzero(np.diff(w, prepend=-1))
                    sums = np.add.reduceat(sc, first)
                    total[w[first]] = sums
                    size = np.diff(np.append(first, len(w)))
                    path = np.repeat(sums.argmax(1), size)
                    # no change of language pays unless all that other languages gain exceeds its cost
                    gain = np.add.reduceat(sc.max(1) - sc[np.arange(len(sc)), path], first)
                    for d in np.flatnonzero(gain > SWITCH_COST):
                        path[first[d] : first[d] + size[d]] = viterbi(sc[first[d] : first[d] + size[d]])
                    r = np.flatnonzero(np.diff(w, prepend=-1) | np.diff(path, prepend=-1))  # starts of the runs
                    end = np.append(r[1:], len(w)) - 1
                    # whole sentences, as far as they are in one language
                    begin = np.diff(w, prepend=-1).astype(bool) | np.diff(path, prepend=-1).astype(bool) | ~np.array(on)
                    b0 = np.flatnonzero(begin)
                    clear = np.zeros(len(w), bool)
                    whole = np.add.reduceat(sc, b0)
                    words = np.concatenate(([0], np.cumsum((buf != 32) & (np.concatenate(([32], buf[:-1])) == 32))))
                    last = hi[np.append(b0[1:], len(w)) - 1]
                    top2 = np.partition(whole, -2, axis=1)[:, -2:]
                    short = np.isin(raw[last - 1], _STOPS) & (words[last] - words[lo[b0]] >= SENTENCE_WORDS) & (top2[:, 1] - top2[:, 0] >= SWITCH_COST)
                    clear[b0] = ((np.add.reduceat(nl, b0) >= SENTENCE_LETTERS) | short) & (whole.argmax(1) == path[b0])
                    owner, score = w[r], np.add.reduceat(sc, r)
                    fields = [path[r], c[r, 2], c[end, 3], np.add.reduceat(nl, r), np.add.reduceat(clear.astype(np.int64), r)]
                six = pa.array(np.arange(len(score) + 1, dtype=np.int32) * n)
                items = pa.StructArray.from_arrays([*(pa.array(v, t) for v, t in zip(fields, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))), pa.ListArray.from_arrays(six, pa.array(score.ravel()))], names=["lang", "start_char", "end_char", "letters", "whole", "score"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)), items)
                totals = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(len(keep) + 1)), totals, runs], names=["k", *keep, "total", "runs"])

    return slim.mapInArrow(run, schema)


def _log(c: Column) -> Column:
    return F.log(F.greatest(c, F.lit(1e-9)))


def fuse(seen: DataFrame, host: str, group: str, suffix: str | None = None) -> DataFrame:
    """Adds ``prior`` (log weights by language) to documents with likelihoods: host priors
    smoothed from the whole to the source to the dossier, and what the declared language
    says, from how often documents of a language carry which declaration. With ``suffix``, a
    column of address suffixes, their share of each language counts in the same way.

    The counts are grouped aggregations over all documents by their likeliest language;
    partial aggregation and join_unique hold for a dossier in any share of the rows.
    """
    top = F.array_position("total", F.array_max("total")) - 1
    d = seen.withColumn("lik", F.when(F.array_max("total") != F.array_min("total"), top)).withColumn("host", F.coalesce(F.col(host), F.lit("?"))).withColumn("grp", F.concat_ws("|", F.col("host"), F.coalesce(F.col(group), F.lit("?"))))
    n = len(LANGUAGES)
    per = lambda by: d.where("lik is not null").groupBy(*by).agg(*(F.count(F.when(F.col("lik") == i, 1)).alias(f"n{i}") for i in range(n)))
    g = per([]).first()
    total = sum(g) or 1
    base = [(x + 1) / (total + n) for x in g]
    share = lambda parent: F.array(*((F.col(f"n{i}") + TIE * parent[i]) / (sum((F.col(f"n{j}") for j in range(n)), F.lit(0)) + TIE) for i in range(n)))
    hosts = per(["host"]).select("host", share([F.lit(x) for x in base]).alias("hp"))
    groups = join_unique(per(["host", "grp"]), hosts, "host").select("grp", share([F.col("hp")[i] for i in range(n)]).alias("prior"))
    told = {r["decl"]: [r[f"n{i}"] for i in range(n)] for r in per(["decl"]).collect()}  # one row per language and one for none
    cols = [sum(v[i] for v in told.values()) for i in range(n)]
    says = {k: [float(np.log((v[i] + 1) / (cols[i] + len(told) + 1))) for i in range(n)] for k, v in told.items() if k}
    markup = F.array(*(F.lit(0.0) for _ in range(n)))
    for k, v in says.items():
        markup = F.when(F.col("decl") == k, F.array(*map(F.lit, v))).otherwise(markup)
    j = join_unique(d, groups, "grp", "left")
    prior = F.transform(F.coalesce("prior", F.array(*map(F.lit, base))), _log)
    if suffix:
        own = per([suffix]).where(F.col(suffix).isNotNull()).select(suffix, F.array(*(_log(x / b) for x, b in zip((share([F.lit(x) for x in base])[i] for i in range(n)), base))).alias("by_suffix"))
        j = join_unique(j, own, suffix, "left")
        prior = F.zip_with(prior, F.coalesce("by_suffix", F.array(*(F.lit(0.0) for _ in range(n)))), lambda a, b: a + b)
    return j.withColumn("prior", F.zip_with(prior, markup, lambda a, b: a + b)).drop("lik", "grp", "by_suffix")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", host: str = "source", group: str = "dossier", suffix: str | None = None, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(key, declared, segment_no, lang_found, confidence, start_char, end_char, whole): one
    row per stretch of a document in one language; a null lang_found for a text without any
    sentence.

    Bayesian fusion: the text's likelihood by language (letter sequences, naive Bayes fitted
    here on a bounded sample), the declared language, and host priors smoothed along
    whole - source - dossier, whose counts cover all documents. Stretches are cut at
    sentence and line ends and joined by a penalised path, so a stretch without a word of
    its own goes with its neighbours. Quoted terms say nothing. ``whole`` counts the whole
    sentences that are in the language by themselves. Null, blank and code-only texts have
    one row with null lang_found and confidence 0. Rows with a null key are left out,
    repeated rows count once; of different rows with one key that of the least hash. A text
    is given one of LANGUAGES, there is no class for others. ``suffix`` names a column of
    address suffixes; the test tables have none.
    """
    d = docs.where(F.col(key).isNotNull()).withColumns({"decl": declared(F.col(lang)), "own": F.xxhash64(text, lang, host, group)})
    model = train(docs, key, text, lang, sample)
    seen = likelihoods(d, key, text, model, ["own", "decl", lang, host, group, *([suffix] if suffix else [])])
    rest = [c for c in seen.columns if c != "k"]
    one = seen.groupBy("k").agg(F.min_by(F.struct(*rest), "own").alias("r")).select("k", *(F.col("r")[c].alias(c) for c in rest))
    seen = write_stage(one, "likelihoods").df
    f = fuse(seen.withColumnRenamed(lang, "raw_lang"), host, group, suffix)
    full = F.filter("runs", lambda r: (r["whole"] > 0) | ((r["letters"] >= 2 * SENTENCE_LETTERS) & (r["letters"] >= 0.6 * (r["end_char"] - r["start_char"]))))
    r = f.select("k", "raw_lang", "decl", "prior", F.posexplode_outer(F.when(F.size(full) > 0, full)).alias("segment_no", "r"))
    post = F.zip_with(F.transform("r.score", lambda x: x * 0.5), F.col("prior"), lambda a, b: a + b)
    top = F.array_max(post)
    conf = 1 / F.aggregate(F.transform(post, lambda x: F.exp(F.greatest(x - top, F.lit(-60.0)))), F.lit(0.0), lambda a, x: a + x)
    found = F.array(*map(F.lit, LANGUAGES))[F.array_position(post, top).cast("int") - 1]
    has = F.col("r").isNotNull()
    return r.select(F.col("k").alias(key), F.col("raw_lang").alias("declared"), F.coalesce("segment_no", F.lit(0)).alias("segment_no"), F.when(has, found).alias("lang_found"), F.when(has, F.round(conf, 6)).otherwise(0.0).alias("confidence"), "r.start_char", "r.end_char", F.coalesce("r.whole", F.lit(0)).alias("whole"))
