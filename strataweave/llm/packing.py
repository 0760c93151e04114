"""Filling fixed-capacity containers with items.

The plan is made from the histogram of lengths, which has at most ``capacity`` rows
however many items there are; items then look up their place by length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Items over this share of the capacity are placed by configurations, the rest by best fit.
LARGE = 1 / 8
#: Classes of equal cardinality to which large lengths are rounded up.
GROUPS = 24


def best_configuration(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Counts per size with the greatest total value that fit (exact knapsack)."""
    k = len(size)
    best = np.zeros(capacity + 1)
    took: list[tuple[int, int, np.ndarray]] = []
    for g in range(k):
        if value[g] <= 1e-12:
            continue
        left, c = capacity // int(size[g]), 1
        while left > 0:
            c = min(c, left)
            w = c * int(size[g])
            take = best[:-w] + c * value[g] > best[w:] + 1e-12
            new = best.copy()
            new[w:][take] = best[:-w][take] + c * value[g]
            took.append((g, c, np.concatenate((np.zeros(w, bool), take))))
            best, left, c = new, left - c, c * 2
    at, counts = int(np.argmax(best)), np.zeros(k)
    total = best[at]
    for g, c, take in reversed(took):
        if take[at]:
            counts[g] += c
            at -= c * int(size[g])
    return float(total), counts


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes with whole multiplicities that cover at most
    ``demand``: the linear programme by column generation, rounded down."""
    k = len(size)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(rounds):
        inv = np.linalg.inv(basis)
        dual = np.ones(k) @ inv
        value, col = best_configuration(np.maximum(dual, 0), size, capacity)
        if value <= 1 + 1e-7:
            break
        x, d = inv @ demand, inv @ col
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = col
    x = np.linalg.inv(basis) @ demand
    left, done = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        col = np.round(basis[:, j]).astype(np.int64)
        m = max(0, int(np.floor(x[j] + 1e-6)))
        used = col > 0
        if used.any():
            m = min(m, int((left[used] // col[used]).min()))
            if m > 0:
                left -= m * col
                done.append((col, m))
    return done


class _Plan:
    """Ranks of each length in order of use, and the room left in runs of containers."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.capacity, self.next, self.rows = capacity, 0, []
        self.used: dict[int, int] = defaultdict(int)
        self.count = dict(zip(map(int, lengths), map(int, counts)))
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def put(self, length: int, each: int, first: int, n: int) -> None:
        """``each`` items of a length into each of ``n`` containers from ``first``."""
        a = self.used[length]
        self.used[length] = a + each * n
        self.rows.append((length, a, a + each * n, first, each))

    def open(self, room: int, first: int, n: int) -> None:
        if room not in self.room:
            insort(self.rooms, room)
        self.room[room].append((first, n))

    def left(self, length: int) -> int:
        return self.count[length] - self.used[length]

    def best_fit(self, length: int) -> None:
        while (n := self.left(length)) > 0:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = min(self.capacity // length, n)
                m = n // each
                self.put(length, each, self.next, m)
                self.open(self.capacity - each * length, self.next, m)
                self.next += m
                continue
            r = self.rooms[i]
            first, m = self.room[r].pop()
            each = min(r // length, n)
            t = min(m, n // each)
            self.put(length, each, first, t)
            if t < m:
                self.room[r].append((first + t, m - t))
            if not self.room[r]:
                del self.room[r]
                self.rooms.pop(i)
            self.open(r - each * length, first, t)


def plan_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, first container, items per container) for all items of
    the histogram: rank r of a length goes to first + (r - rank_from) // per container.

    Large lengths are rounded up to the greatest of their equal-cardinality group;
    configurations of the rounded sizes are optimised and filled with items of the true
    lengths; the room this leaves, and what rounding left over, is filled by best fit from
    the longest item to the shortest.
    """
    order = np.argsort(-lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    p = _Plan(lengths, counts, capacity)
    big = lengths > capacity * large
    if big.any():
        size, n = lengths[big], counts[big]
        upto = np.cumsum(n)
        group = np.minimum((upto - n) * groups // upto[-1], groups - 1)  # a length isn't divided
        ids, first = np.unique(group, return_index=True)
        rounded = size[first]
        demand = np.array([n[group == g].sum() for g in ids], float)
        runs = [[[int(s), int(c)] for s, c in zip(size[group == g], n[group == g])] for g in ids]
        for col, m in configurations(rounded, demand, capacity):
            slots = [g for g in range(len(ids)) for _ in range(int(col[g]))]
            todo = m
            taken: list[list[list[int]]] = []
            for g in slots:  # the next m items of the group, as runs of one length
                need, got = m, []
                while need:
                    s, c = runs[g][0]
                    t = min(c, need)
                    got.append([s, t])
                    need -= t
                    runs[g][0][1] -= t
                    if runs[g][0][1] == 0:
                        runs[g].pop(0)
                taken.append(got)
            while todo:
                t = min(x[0][1] for x in taken)
                room = capacity
                mix: dict[int, int] = defaultdict(int)
                for x in taken:
                    mix[x[0][0]] += 1
                    room -= x[0][0]
                    x[0][1] -= t
                    if x[0][1] == 0:
                        x.pop(0)
                for s, each in mix.items():
                    p.put(s, each, p.next, t)
                p.open(room, p.next, t)
                p.next += t
                todo -= t
    for s in lengths.tolist():
        p.best_fit(s)
    return p.rows


def pack(items: DataFrame, capacities: DataFrame, item: str = "doc_id", size: str = "n_tokens", bucket_rows: int = 200_000) -> DataFrame:
    """(profile, item, piece_no, size_from, n_tokens, container_id) of every item in every profile.

    ``items`` has one row per item; ``capacities`` has profile_id and capacity_tokens. An
    item over the capacity is cut into full containers and a rest, and only such an item
    is cut. Items of size 0 or null need no room and have a null container; profiles with
    a null or non-positive capacity give no rows. Container ids run from 0 without gaps
    within a profile. Ranks within a length are counted in hashed buckets of about
    ``bucket_rows`` rows, so no length, however frequent, is ranked in one task.
    """
    caps = [(int(r[0]), int(r[1])) for r in capacities.select("profile_id", "capacity_tokens").where("profile_id is not null and capacity_tokens > 0").distinct().collect()]
    spark = items.sparkSession
    if not caps:
        caps_df = spark.createDataFrame([], "profile_id int, cap int")
    else:
        caps_df = spark.createDataFrame(caps, "profile_id int, cap int")
    base = items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    full = base.crossJoin(F.broadcast(caps_df)).select(
        "profile_id", "item", "n", "cap", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / F.col("cap")) - 1, F.lit(0)).cast("int"))).alias("piece_no")
    )
    pieces = full.select("profile_id", "item", "piece_no", (F.col("piece_no").cast("long") * F.col("cap")).alias("size_from"), F.least(F.col("cap").cast("long"), F.col("n") - F.col("piece_no").cast("long") * F.col("cap")).cast("int").alias("length"))
    hist = pieces.where("length > 0").groupBy("profile_id", "length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most the sum of capacities rows
    total = int(hist["n"].sum()) if len(hist) else 0
    buckets = max(1, -(-total // bucket_rows))
    plans: dict[int, tuple[np.ndarray, ...]] = {}
    for pid, cap in caps:
        h = hist[hist.profile_id == pid]
        if len(h):
            r = np.array(plan_containers(h["length"].to_numpy(), h["n"].to_numpy(), cap), np.int64)
            r = r[np.lexsort((r[:, 1], r[:, 0]))]
            plans[pid] = tuple(r[:, i] for i in range(5))
    shared = spark.sparkContext.broadcast(plans)  # bounded by the capacities, not by the items
    b = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "piece_no"), F.lit(buckets)).cast("int"))
    w = W.partitionBy("profile_id", "length", "bucket").orderBy("item", "piece_no")
    if buckets == 1:
        ranked = b.withColumn("rank", F.row_number().over(w) - 1)
    else:
        per = b.groupBy("profile_id", "length", "bucket").agg(F.count(F.lit(1)).alias("c"))
        before = per.select("profile_id", "length", "bucket", (F.sum("c").over(W.partitionBy("profile_id", "length").orderBy("bucket")) - F.col("c")).alias("before"))
        ranked = b.withColumn("rank", F.row_number().over(w) - 1).join(before, ["profile_id", "length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = np.full(len(x), -1, np.int64)
            for pid, (ln, a, _, first, each) in shared.value.items():
                at = np.flatnonzero(((x["profile_id"] == pid) & (x["length"] > 0)).to_numpy())
                if len(at):
                    L, r = x["length"].to_numpy()[at].astype(np.int64), x["rank"].to_numpy()[at].astype(np.int64)
                    lo, hi = np.searchsorted(ln, L, "left"), np.searchsorted(ln, L, "right")
                    while (lo < hi - 1).any():  # last interval of the length that starts at or before the rank
                        mid = (lo + hi) // 2
                        ok = (lo < hi - 1) & (a[np.minimum(mid, len(a) - 1)] <= r)
                        hi = np.where((lo < hi - 1) & ~ok, mid, hi)
                        lo = np.where(ok, mid, lo)
                    got[at] = first[lo] + (r - a[lo]) // each[lo]
            x["container_id"] = pd.array(np.where(got < 0, 0, got), "Int64")
            x.loc[got < 0, "container_id"] = pd.NA
            yield x[["profile_id", "item", "piece_no", "size_from", "length", "container_id"]]

    kind = items.schema[item].dataType.simpleString()
    out = ranked.select("profile_id", "item", "piece_no", "size_from", "length", F.col("rank").cast("long").alias("rank")).mapInPandas(place, f"profile_id int, item {kind}, piece_no int, size_from long, length int, container_id long")
    return out.select("profile_id", F.col("item").alias(item), "piece_no", "size_from", F.col("length").alias("n_tokens"), "container_id")


def utilisation(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens and the share of unused room of each profile."""
    caps = capacities.select("profile_id", "profile_name", "capacity_tokens").distinct()
    used = packed.where("container_id is not null").groupBy("profile_id").agg((F.max("container_id") + 1).alias("n_containers"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.count(F.when(F.col("piece_no") > 0, 1)).alias("n_cuts"))
    room = F.col("n_containers") * F.col("capacity_tokens")
    return used.join(caps, "profile_id").select("profile_id", "profile_name", "capacity_tokens", "n_containers", "n_tokens", "n_cuts", F.round(1 - F.col("n_tokens") / room, 6).alias("unused_share"))

