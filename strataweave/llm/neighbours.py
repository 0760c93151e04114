"""Most similar vectors for every vector."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataweave.plans.lineage import write_stage
from strataweave.plans.skew import join_spread

#: Base hashes that a cell joins: of each of so many rotations the axis in which a vector lies
#: furthest out. 128 cubed cells a table hold the vectors that are alike by chance apart.
CELL = 3
#: Share of the pairs at the similarity searched that meet in a cell of at least one table; how
#: many tables that takes follows from the similarity and from how far the vectors lie from
#: their mean, at every number of vectors alike.
MEET = 0.99
#: Single projections in which collisions are counted, and how many of them make a candidate.
PROJECTIONS, COLLISIONS = 12, 9
#: Half-widths of the query-centred windows, in standard deviations of the difference of two
#: vectors at the radius searched: in the array that is walked, and in those that are counted.
WALK, WINDOW = 3.0, 2.0
#: Base buckets of a counted projection in half a window at the radius searched; a smaller
#: radius takes fewer of them (virtual rehashing), nothing is hashed again.
LEVEL = 8


def usable(df: DataFrame, key: str, vector: str, dim: int = 64) -> DataFrame:
    """(id, v) of the rows whose vector has ``dim`` finite values that are not all zero.
    Null ids are left out and repeated rows count once."""
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(_ok("v", dim))


def _ok(name: str, dim: int):
    v = F.col(name)
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028234663852886e38))) & F.exists(v, lambda x: x != 0)


def rotations(count: int, dim: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)]).astype(np.float32)


def collide(cosine: float, dim: int, trials: int = 20_000, seed: int = 11) -> float:
    """Probability that two directions of that cosine share a base hash, by simulation."""
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z / np.linalg.norm(z, axis=1, keepdims=True)
    return float((extremes(x) == extremes(y)).mean())


def n_tables(min_cosine: float, mean: np.ndarray, dim: int) -> int:
    """Tables in which a share of MEET of the pairs of ``min_cosine`` shares a cell. Vectors are
    hashed as seen from their mean: the further out that is, the wider is the angle."""
    seen = 1 - (1 - min_cosine) / max(1e-3, 1 - float(mean @ mean))
    p = max(collide(max(seen, 0.0), dim), 1e-2) ** CELL
    return math.ceil(math.log(1 - MEET) / math.log(1 - p))


def _matrix(col: pa.Array) -> np.ndarray:
    off = np.asarray(col.offsets)
    x = np.asarray(col.values)[off[0] : off[-1]].reshape(len(col), -1).astype(np.float32)
    x /= np.abs(x).max(1, keepdims=True)  # against overflow of the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def extremes(y: np.ndarray) -> np.ndarray:
    """The axis, with its sign, in which each row lies furthest out."""
    top = np.abs(y).argmax(1)
    return top + y.shape[1] * (y[np.arange(len(y)), top] < 0)


def centre(vectors: DataFrame, dim: int = 64) -> tuple[np.ndarray, int]:
    """Mean direction and number of all vectors, from one partial sum per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                total += _matrix(b.column(0)).sum(0, dtype=np.float64)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "s"])

    rows = vectors.select("v").mapInArrow(run, "n long, s array<double>").collect()  # one row per partition
    n = sum(r["n"] for r in rows)
    return (np.sum([r["s"] for r in rows], axis=0) / max(n, 1)).astype(np.float32) if rows else np.zeros(dim, np.float32), n


def index_rows(vectors: DataFrame, mean: np.ndarray, tables: int, radius: float, dim: int = 64) -> DataFrame:
    """(cell, at, code, id): a row per table and vector, few bytes each. The cell is the table, its
    base hashes and a stretch of eight windows of the sorted projection ``at``; rows within one
    window of the next stretch are in both. The code holds the base buckets of the counted
    projections, a byte each."""
    sigma = radius / math.sqrt(dim)
    width, bucket = np.float32(WALK * sigma), np.float32(WINDOW * sigma / LEVEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot, single = rotations(CELL * tables, dim), rotations(1, dim, 8)[0]
        for b in batches:
            for part in range(0, b.num_rows, 4000):
                c = b.slice(part, 4000)
                n = c.num_rows
                x = _matrix(c.column(1)) - mean
                pos = x @ single
                code = np.floor(pos[:, :PROJECTIONS] / bucket).astype(np.int64).astype(np.uint8)
                cells, places = [], []
                for t in range(tables):
                    cell = np.full(n, t, np.int64)
                    for r in rot[CELL * t : CELL * t + CELL]:
                        cell = (cell << 7) | extremes(x @ r)
                    cells.append(cell)
                    places.append(pos[:, PROJECTIONS + t % (dim - PROJECTIONS)])
                cell, at, take = np.concatenate(cells), np.concatenate(places), np.tile(np.arange(n), tables)
                stretch = np.floor(at / (8 * width)).astype(np.int64)
                again = np.flatnonzero(at >= (stretch + 1) * 8 * width - width)
                cell = (np.concatenate((cell, cell[again])) << 10) | (np.concatenate((stretch, stretch[again] + 1)) & 1023)
                rows = np.concatenate((take, take[again]))
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PROJECTIONS), len(rows), [None, pa.py_buffer(code[rows].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate((at, at[again]))), codes, c.column(0).take(pa.array(rows))], names=["cell", "at", "code", "id"])

    return vectors.select("id", "v").mapInArrow(run, "cell long, at float, code binary, id long")


def count_collisions(code: np.ndarray, a: np.ndarray, b: np.ndarray, level: int = LEVEL) -> np.ndarray:
    """In how many projections the rows a of ``code`` lie in the windows of ``level`` base buckets
    around the rows b."""
    off = (code[a] - code[b]).view(np.int8)
    return ((off >= -level) & (off <= level)).sum(1)


def candidates(index: DataFrame, radius: float, dim: int = 64) -> DataFrame:
    """(a, b), a < b: pairs that reach COLLISIONS. The index is sorted by cell and projection, and a
    window that is centred on each row in turn moves along it; what it holds is all that a
    task keeps. Collisions are counted for what lies in the window."""
    width = WALK * radius / math.sqrt(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at, code, ids = np.empty(0, np.int64), np.empty(0), np.empty((0, PROJECTIONS), np.uint8), np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            old = len(cell)
            cell, at = np.concatenate((cell, b.column(0).to_numpy())), np.concatenate((at, b.column(1).to_numpy().astype(np.float64)))
            code = np.concatenate((code, np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, PROJECTIONS)))
            ids = np.concatenate((ids, b.column(3).to_numpy()))
            rank = np.concatenate(([0], np.cumsum(cell[1:] != cell[:-1])))
            key = rank * 64.0 + at  # ascending, as no projection is beyond 2
            first = np.searchsorted(key, key - width)
            first = np.maximum(first, np.searchsorted(rank, rank))
            n = np.arange(len(cell)) - first
            n[:old] = 0  # have met before
            ends = np.cumsum(n)
            lo = old
            while lo < len(n):  # so many pairs at a time as fit into the memory
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000, "right")))
                k = n[lo:hi]
                if k.sum():
                    y = np.repeat(np.arange(lo, hi), k)
                    x = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[lo:hi], k)
                    hit = np.flatnonzero((count_collisions(code, x, y) >= COLLISIONS) & (ids[x] != ids[y]))
                    p, q = ids[x[hit]], ids[y[hit]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])
                lo = hi
            keep = np.flatnonzero((cell == cell[-1]) & (at >= at[-1] - width))
            cell, at, code, ids = cell[keep], at[keep], code[keep], ids[keep]

    return index.repartition("cell").sortWithinPartitions("cell", "at").mapInArrow(run, "a long, b long").distinct()


def similar_classes(df: DataFrame, key: str, vector: str, min_cosine: float = 0.95, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, cosine) of class representatives, members (rep, id) of the classes of copies).

    Collision counting: rows of sorted single projections that share a cell and lie in the
    window centred on a query have their collisions over all counted projections summed up;
    those with COLLISIONS or more are verified by the exact cosine in double precision. Of
    copies of one vector only the first is indexed, so copies never fill a cell. Unusable
    vectors and null ids are left out; repeated rows count once; an empty table gives no
    pairs.
    """
    radius = float(np.sqrt(2 * (1 - min_cosine)))
    u = usable(df, key, vector, dim)
    mean, n = centre(u, dim)
    per = u.select("id", F.xxhash64("v").alias("same")).distinct()
    copies = per.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = write_stage(join_spread(per, copies.select("same", "rep"), "same").select("rep", "id"), "copies").df
    lone = u.join(members.where("id <> rep").select("id"), "id", "left_anti")
    found = write_stage(candidates(index_rows(lone, mean, n_tables(min_cosine, mean, dim), radius, dim), radius, dim), "candidates")
    ends = found.df.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    v = u.join(ends, "id").groupBy("id").agg(F.first("v").alias("v"))
    full = found.df.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                p, q = (_matrix(x.column(i)).astype(np.float64) for i in (2, 3))
                c = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1))
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(c)], names=["a", "b", "cosine"]).filter(pa.array(c >= min_cosine - 1e-7))

    return full.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long, cosine double"), members


def similar_pairs(df: DataFrame, key: str, vector: str, min_cosine: float = 0.95, dim: int = 64) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: pairs with at least ``min_cosine``, those of copies
    included (``similar_classes`` has the pairs of representatives and the classes)."""
    linked, members = similar_classes(df, key, vector, min_cosine, dim)
    side = lambda s, to: members.select(F.col("rep").alias(s), F.col("id").alias(to))
    across = linked.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "cosine")
    within = join_spread(side("r", "x"), side("r", "y"), "r").where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "cosine")


def top_k(df: DataFrame, key: str, vector: str, queries: str = "id % 20 = 0", k: int = 10, dim: int = 64, query_block: int = 32_768, row_block: int = 32_768) -> DataFrame:
    """(id, rank, neighbour, cosine): exact k nearest rows of the stated query set.

    Queries meet all rows in blocks: one matrix product per pair of blocks, of which only
    the k best of each query leave the task. Ties go to the smaller id. A query has fewer
    than k rows only if the table has. Unusable vectors take no part.
    """
    u = usable(df, key, vector, dim).dropDuplicates(["id"])
    n = u.agg(F.count(F.lit(1)), F.count(F.when(F.expr(queries), 1))).first()
    # every row goes to each block of queries and every query to each block of rows, so both
    # blocks are as large as a task's memory allows; only small inputs are cut finer, to
    # occupy the cluster
    rows_per = min(row_block, max(2048, -(-int(n[0]) // df.sparkSession.sparkContext.defaultParallelism)))
    nb, nq = max(1, -(-int(n[0]) // rows_per)), max(1, -(-int(n[1]) // query_block))
    side = lambda d, m: d.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"))
    rows = side(u, nb).select("block", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "id", "v", F.lit(False).alias("q"))
    asks = side(u.where(F.expr(queries)), nq).select(F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("block"), F.col("block").alias("qb"), "id", "v", F.lit(True).alias("q"))

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        q = t.column("q").to_numpy()
        ids = t.column("id").to_numpy()
        col = t.column("v")
        x = _matrix(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col)
        base, bid, ask, aid = x[~q], ids[~q], x[q], ids[q]
        order = np.argsort(bid)
        base, bid = base[order], bid[order]
        got: list[tuple[np.ndarray, ...]] = []
        m = min(k + 1, len(bid))
        for s in range(0, len(ask), 128) if m else ():
            sc = ask[s : s + 128] @ base.T
            top = np.argpartition(-sc, m - 1, axis=1)[:, :m]
            v = np.take_along_axis(sc, top, 1)
            a = np.repeat(aid[s : s + 128], m)
            got.append((a, bid[top].ravel(), v.ravel()))
        a, b, v = (np.concatenate([g[i] for g in got]) if got else np.array([], np.int64 if i < 2 else np.float32) for i in range(3))
        keep = a != b
        return pa.table({"id": pa.array(a[keep], pa.int64()), "neighbour": pa.array(b[keep], pa.int64()), "cosine": pa.array(v[keep].astype(np.float64))})

    part = rows.unionByName(asks).groupBy("block", "qb").applyInArrow(search, "id long, neighbour long, cosine double")
    w = W.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "neighbour", F.round("cosine", 5).alias("cosine"))

