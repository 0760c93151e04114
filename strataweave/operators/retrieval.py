"""Dense, set-overlap and BM25 retrieval, fusion, ranking metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataweave.functions.text import word_set, words
from strataweave.plans.lineage import Stage, write_stage

#: Okapi constants.
K1, B, EPSILON = 1.5, 0.75, 0.25


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalised(score: Column) -> Column:
    """(cosine + 1) / 2 held within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def dense_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", threshold: float | None = None) -> DataFrame:
    """The k nearest rows of one query vector; the query is a literal, so the scan is one
    narrow pass that keeps k rows per task. Ties go to the smaller key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    s = vectors.select(key, cosine(F.col(vector), q).alias("score"))
    if threshold is not None:
        s = s.where(F.col("score") >= threshold)
    return s.orderBy(F.col("score").desc(), key).limit(k)


def sparse_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): Jaccard of the word sets, where it is above 0. The filter on shared
    words comes before the score, in one narrow pass."""
    q = F.array_distinct(F.array(*(F.lit(w) for w in query.lower().split())))
    x = docs.select(key, word_set(text).alias("w")).withColumn("both", F.size(F.array_intersect("w", q))).where("both > 0")
    return x.select(key, (F.col("both") / (F.size("w") + F.size(q) - F.col("both"))).alias("score"))


def bm25_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of documents that share a query word: Okapi BM25 whose negative inverse
    frequencies are raised to EPSILON times the mean one.

    Only the words' counts leave the scan: lengths and query-word frequencies come from one
    pass; the mean inverse frequency needs the document frequency of every word, which is
    one aggregation over distinct (document, word)."""
    d = docs.select(F.col(key), words(F.lower(text)).alias("w")).withColumn("dl", F.size("w"))
    n_docs = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = d.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n_docs)).select("t", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    floor = idf.agg((F.avg("idf") * EPSILON).alias("floor"))
    terms = query.lower().split()
    q = F.array(*(F.lit(t) for t in terms))
    wanted = idf.where(F.col("t").isin(*terms)).crossJoin(F.broadcast(floor)).select("t", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    tf = d.select(key, "dl", F.explode(F.filter("w", lambda x: F.array_contains(q, x))).alias("t")).groupBy(key, "dl", "t").agg(F.count(F.lit(1)).alias("tf"))
    times = {t: terms.count(t) for t in terms}
    m = F.create_map(*[F.lit(x) for kv in times.items() for x in kv])
    s = tf.join(F.broadcast(wanted), "t").crossJoin(F.broadcast(n_docs.select("avgdl")))
    part = m[F.col("t")] * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return s.groupBy(key).agg(F.sum(part).alias("score"))


def best(scores: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best scores above 0; ties go to the smaller key."""
    return scores.where("score > 0").orderBy(F.col("score").desc(), key).limit(k)


#: Folders that the words of an index are spread over; a query opens those of its words.
SLICES = 64


@dataclass
class TextIndex:
    """An inverted index: built once, asked often.

    ``postings`` has a row per word and document (t, key, tf, dl, nw, idf), in a folder per slice
    of the words and sorted by word, so a query reads only the row groups of its words and no
    text; the inverse frequency, raised to its floor, is stored with each. ``n_docs`` and
    ``mean_length`` are of the whole."""

    postings: Stage
    key: str
    n_docs: int
    mean_length: float

    @staticmethod
    def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> TextIndex:
        """Index of documents (key, text). Null texts have no words; an empty table an empty index."""
        d = docs.select(F.col(key).alias("key"), words(F.lower(text)).alias("w"))
        d = d.select("key", "w", F.size("w").alias("dl"), F.size(F.array_distinct("w")).alias("nw"))
        one = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
        n, mean = one["n"], one["mean"] or 0.0
        tf = write_stage(d.select("key", "dl", "nw", F.explode("w").alias("t")).groupBy("key", "dl", "nw", "t").agg(F.count(F.lit(1)).alias("tf")), "tf")
        df = tf.df.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        idf = df.select("t", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
        floor = (idf.agg(F.avg("raw")).first()[0] or 0.0) * EPSILON
        idf = idf.select("t", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
        rows = tf.df.join(idf, "t").withColumn("slice", F.pmod(F.xxhash64("t"), F.lit(SLICES)).cast("int"))
        out = write_stage(rows.repartition("slice").sortWithinPartitions("slice", "t"), "postings", ["slice"])
        tf.drop()
        return TextIndex(out, key, n, mean)

    def scores(self, queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
        """(query, key, bm25, jaccard) of the documents that share a word with a query: Okapi BM25 (to
        nine places, so that equal texts tie) and the likeness of the word sets. One join and one aggregation for any number of queries."""
        q = queries.select(F.col(query).alias("q"), words(F.lower(text)).alias("w"))
        q = q.select("q", F.size(F.array_distinct("w")).alias("nq"), F.explode("w").alias("t")).groupBy("q", "nq", "t").agg(F.count(F.lit(1)).alias("m"))
        return self._scored(self.postings.df.join(q, "t"), query)

    def scores_of(self, text: str) -> DataFrame:
        """(key, bm25, jaccard) for one query: its words are literals, so only their slices and row
        groups are read."""
        terms = text.lower().split()
        if not terms:
            return self._scored(self.postings.df.where("false").withColumns({"q": F.lit(0), "nq": F.lit(0), "m": F.lit(0)}), "q").drop("q")
        times = F.create_map(*[F.lit(x) for t in dict.fromkeys(terms) for x in (t, terms.count(t))])
        here = F.lit(False)
        for t in set(terms):
            here = here | (F.col("slice") == F.pmod(F.xxhash64(F.lit(t)), F.lit(SLICES)).cast("int"))
        p = self.postings.df.where(here & F.col("t").isin(*set(terms)))
        p = p.withColumns({"q": F.lit(0), "nq": F.lit(len(set(terms))), "m": times[F.col("t")]})
        return self._scored(p, "q").drop("q")

    def _scored(self, hits: DataFrame, query: str) -> DataFrame:
        part = F.col("m") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / self.mean_length))
        g = hits.groupBy("q", "key", "nw", "nq").agg(F.round(F.sum(part), 9).alias("bm25"), F.count(F.lit(1)).alias("both"))
        return g.select(F.col("q").alias(query), F.col("key").alias(self.key), "bm25", (F.col("both") / (F.col("nw") + F.col("nq") - F.col("both"))).alias("jaccard"))

    def hybrid(self, queries: DataFrame, k: int, each: int = 40, wa: float = 0.6, wb: float = 0.4, query: str = "query_id", text: str = "text") -> DataFrame:
        """(query, key, score, rank) of the k best per query: the ``each`` best by BM25 and by word
        sets, each side divided by its own maximum, weighted and summed. Ties go to the smaller
        key. The best are kept map-side before anything is shuffled by query."""
        s = self.scores(queries, query, text)
        first = lambda by, name: s.where(F.col(by) > 0).withColumn("r", F.row_number().over(W.partitionBy(query).orderBy(F.col(by).desc(), self.key))).where(F.col("r") <= each).select(query, self.key, (F.col(by) / F.max(by).over(W.partitionBy(query))).alias(name))
        j = first("bm25", "a").join(first("jaccard", "b"), [query, self.key], "full_outer").fillna(0.0, ["a", "b"])
        j = j.select(query, self.key, F.round(wa * F.col("a") + wb * F.col("b"), 5).alias("score"))
        return j.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.col("score").desc(), self.key))).where(F.col("rank") <= k)


@dataclass
class VectorIndex:
    """Vectors divided by their lengths, written once; a query is one product a row."""

    rows: Stage
    key: str

    @staticmethod
    def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        v = F.transform(vector, lambda x: x.cast("double"))
        x = vectors.select(F.col(key).alias("key"), v.alias("v")).withColumn("n", F.sqrt(dot(F.col("v"), F.col("v"))))
        return VectorIndex(write_stage(x.select("key", F.when(F.col("n") > 0, F.transform("v", lambda y: y / F.col("n"))).otherwise(F.col("v")).alias("u")), "vectors"), key)

    def top_k(self, query: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
        """(key, score): the k rows of the greatest cosine to the one vector ``u`` of ``query`` (one
        row), which goes to all tasks; every task keeps k rows. Ties go to the smaller key."""
        s = self.rows.df.crossJoin(F.broadcast(query.select(F.col("u").alias("q")))).select(F.col("key").alias(self.key), F.aggregate(F.zip_with("u", "q", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x).alias("score"))
        if threshold is not None:
            s = s.where(F.col("score") >= threshold)
        return s.orderBy(F.col("score").desc(), self.key).limit(k)


def fuse(a: DataFrame, b: DataFrame, key: str = "doc_id", wa: float = 0.6, wb: float = 0.4, per_side: bool = True) -> DataFrame:
    """Full outer fusion of two score lists. ``per_side``: each divided by its own maximum;
    else the weighted sum divided by its maximum. The inputs are top-k lists."""
    j = a.select(key, F.col("score").alias("sa")).join(b.select(key, F.col("score").alias("sb")), key, "full_outer").fillna(0.0, ["sa", "sb"])
    if per_side:
        top = j.agg(F.max("sa").alias("ma"), F.max("sb").alias("mb"))
        part = lambda s, m: F.when(F.col(m) > 0, F.col(s) / F.col(m)).otherwise(0.0)
        return j.crossJoin(F.broadcast(top)).select(key, (wa * part("sa", "ma") + wb * part("sb", "mb")).alias("score"))
    j = j.select(key, (wa * F.col("sa") + wb * F.col("sb")).alias("score"))
    top = j.agg(F.max("score").alias("m"))
    return j.crossJoin(F.broadcast(top)).select(key, F.when(F.col("m") > 0, F.col("score") / F.col("m")).otherwise(0.0).alias("score"))


def expand(variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """Running pairwise mean (old + new) / 2 over the variants (key, variant_no, score) in order."""
    ordered = variants.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("variant_no", "score"))).alias("v"))  # a few variants per key
    return ordered.select(key, F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.col("v")[0]["score"], lambda a, x: (a + x["score"]) / 2).alias("score"))


def ranking_metrics(ranked: DataFrame, query: str = "query_id", cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per query from rows (query, rank from 1, relevant): recall and precision at the
    cutoffs, NDCG at the last, reciprocal and mean rank of relevant items; one aggregation."""
    rel, r, k = F.col("relevant"), F.col("rank"), cutoffs[-1]
    hit = lambda c: F.count(F.when(rel & (r <= c), 1))
    g = ranked.groupBy(query).agg(F.count(F.when(rel, 1)).alias("n_rel"), *(hit(c).alias(f"h{c}") for c in cutoffs), F.sum(F.when(rel & (r <= k), 1 / F.log2(r + 1.0)).otherwise(0.0)).alias("dcg"), F.min(F.when(rel, r)).alias("first"), F.avg(F.when(rel, r)).alias("mean_rank"))
    n = F.least(F.col("n_rel"), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    z = lambda c: F.when(F.col("n_rel") > 0, c).otherwise(0.0)
    return g.select(query, *(F.round(z(F.col(f"h{c}") / F.col("n_rel")), 6).alias(f"recall_{c}") for c in cutoffs), *(F.round(F.col(f"h{c}") / c, 6).alias(f"precision_{c}") for c in cutoffs), F.round(z(F.col("dcg") / ideal), 6).alias(f"ndcg_{k}"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("mean_rank", F.lit(0.0)), 6).alias("mean_rank"))


def context(hits: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 400) -> DataFrame:
    """(context, confidence): the hits' texts, cut to ``most`` characters, in rank order, and
    the mean score. ``hits`` is a top-k list with ``rank``."""
    j = hits.join(docs.select(key, text), key)
    one = F.concat(F.lit("["), F.col(key).cast("string"), F.lit("] "), F.substring(text, 1, most))
    return j.agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))), lambda x: x["t"])).alias("context"), F.round(F.avg("score"), 6).alias("confidence"))


def ranked(top: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``rank`` to a top-k list (k rows, so one window over all of them)."""
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), key)))
