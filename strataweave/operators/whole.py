"""Graph methods of many cheap rounds, run in one task over a graph of whole numbers.

A round of joins costs some jobs, however small the graph; in memory it costs milliseconds.
What is read is two numbers an edge, so a task holds graphs far larger than their tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Simple edges up to which a graph is held by one task (about 200 bytes each at the peak); beyond it rounds are joins.
TASK_EDGES = 4_000_000

#: Vectors of a Krylov space that are kept at a time.
BASIS = 8


def coded(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids in order, and the ends of the edges as places among them."""
    a, b = [], []
    for x in batches:
        a.append(x.column(0))
        b.append(x.column(1))
    if not a:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = pa.concat_arrays([*a, *b]).dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[d.indices.to_numpy()]
    return d.dictionary.take(pa.array(order)), at[: len(at) // 2], at[len(at) // 2 :]


def in_one_task(pairs: DataFrame, method: Callable[..., np.ndarray | tuple[np.ndarray, ...]], column: str, kind: str) -> DataFrame:
    """(id, column) of ``method(a, b, names)``, a value a node: a number, or for kind ``id`` the place
    of another node. ``column`` may be several names, for a method of as many arrays."""
    id_kind, columns = pairs.schema["a"].dataType.simpleString(), column.split()

    def run(batches):
        names, a, b = coded(batches)
        if len(names):
            x = method(a, b, names)
            out = [names, *(names.take(pa.array(y)) if kind == "id" else pa.array(y) for y in (x if isinstance(x, tuple) else (x,)))]
            for s in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays([y[s : s + 100_000] for y in out], names=["id", *columns])

    return pairs.select("a", "b").coalesce(1).mapInArrow(run, ", ".join([f"id {id_kind}", *(f"{c} {id_kind if kind == 'id' else kind}" for c in columns)]))


def is_forest(a: np.ndarray, b: np.ndarray, n: int) -> bool:
    """Whether nothing is left when leaves are taken away again and again."""
    while len(a):
        d = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        keep = (d[a] > 1) & (d[b] > 1)
        if keep.all():
            return False
        a, b = a[keep], b[keep]
    return True


def non_backtracking(a: np.ndarray, b: np.ndarray, n: int, rounds: int, tolerance: float) -> np.ndarray:
    """Leading eigenvector of the non-backtracking matrix summed by edge source, the greatest
    scaled to 1: Arnoldi's method from equal values, begun again with its best vector. Also
    where a second eigenvalue is as large (two-sided graphs) or nearly so. The residual
    over the eigenvalue must come under ``tolerance`` within ``rounds`` products, or all is NaN."""
    if is_forest(a, b, n):
        return np.zeros(n)
    m, u, v = len(a), np.concatenate([a, b]), np.concatenate([b, a])

    def step(x: np.ndarray) -> np.ndarray:
        y = np.bincount(u, x, n)[v]
        y[:m] -= x[m:]
        y[m:] -= x[:m]
        return y

    x, used = np.full(2 * m, (2 * m) ** -0.5), 0
    base, h = np.empty((BASIS + 1, 2 * m)), None
    while used < rounds:
        base[0], h, k = x, np.zeros((BASIS + 1, BASIS)), 0
        while k < min(BASIS, rounds - used):
            w = step(base[k])
            for _ in range(2):
                c = base[: k + 1] @ w
                w -= c @ base[: k + 1]
                h[: k + 1, k] += c
            h[k + 1, k] = np.linalg.norm(w)
            k += 1
            if h[k, k - 1] <= 1e-13 * np.abs(h[:k, :k]).max():
                h[k, k - 1] = 0.0
                break
            base[k] = w / h[k, k - 1]
        used += k
        values, vectors = np.linalg.eig(h[:k, :k])
        i = int(np.argmax(values.real))
        c = vectors[:, i]
        c = c.real if np.abs(c.real).sum() >= np.abs(c.imag).sum() else c.imag
        x = c @ base[:k]
        x /= np.linalg.norm(x)
        if values[i].imag == 0 and h[k, k - 1] * abs(vectors[k - 1, i]) <= tolerance * values[i].real:
            s = np.abs(np.bincount(u, np.abs(x), n))
            return s / s.max()
    return np.full(n, np.nan)


def marks(names: pa.Array) -> np.ndarray:
    """A hash of each id, the same as Spark's crc32."""
    return np.array([zlib.crc32(str(x).encode()) for x in names.to_pylist()], np.int64)


def _sums(u: np.ndarray, v: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (u, v) in order, each once, with the sum of w; both are under k."""
    key = u * k + v
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] // k, key[first] % k, np.add.reduceat(w[order], first) if len(first) else np.zeros(0)


def _starts(u: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))


def louvain(a: np.ndarray, b: np.ndarray, n: int, mark: np.ndarray, least_gain: float) -> np.ndarray:
    """The steps of ``structural.louvain``: per node the least of its community."""
    u, v, w, m2 = np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a)), 2.0 * len(a)
    at, best = np.arange(n), -1.0
    while True:
        k = len(mark)
        weight = np.bincount(u, w, k)
        c, first, last, turn = np.arange(k), best, best, 0
        far = u != v
        fu, fv, fw = u[far], v[far], w[far]
        while True:
            for half in (0, 1):
                mine = (mark >> (turn // 2 % 32)) & 1 == half
                total = np.bincount(c, weight, k)
                own = mine[fu]
                x, y, s = _sums(fu[own], c[fv[own]], fw[own], k)
                if len(x):
                    same = y == c[x]
                    gain = np.round(s - weight[x] * (total[y] - np.where(same, weight[x], 0.0)) / m2, 9)
                    stay_w = np.zeros(k)
                    stay_w[x[same]] = s[same]
                    start = _starts(x)
                    node, top = x[start], np.maximum.reduceat(gain, start)
                    to = np.minimum.reduceat(np.where(gain == np.repeat(top, np.diff(np.append(start, len(x)))), y, k), start)
                    move = top > np.round(stay_w[node] - weight[node] * (total[c[node]] - weight[node]) / m2, 9)
                    c[node[move]] = to[move]
                turn += 1
            q = w[c[u] == c[v]].sum() / m2 - ((np.bincount(c, weight, k) / m2) ** 2).sum()
            if q <= last + least_gain:
                break
            last = q
        best = max(q, last)
        if best <= first + least_gain:
            break
        least = np.full(k, k)
        np.minimum.at(least, c, np.arange(k))
        kept, place = np.unique(least[c], return_inverse=True)
        at, mark = place[at], mark[kept]
        u, v, w = _sums(place[u], place[v], w, len(kept))
    least = np.full(len(mark), n)
    np.minimum.at(least, at, np.arange(n))
    return least[at]


def greedy_modularity(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The steps of ``structural.greedy_modularity``: per node the least of its community."""
    u, v, w, m2 = np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a)), 2.0 * len(a)
    at, name = np.arange(n), np.arange(n)
    while True:
        k = len(name)
        share = np.bincount(u, w, k) / m2
        order = np.argsort(u, kind="stable")
        x, y, s = u[order], v[order], w[order]
        gain = np.round(s / m2 - share[x] * share[y], 12)
        good = (gain > 0) & (x != y)
        x, y, gain = x[good], y[good], gain[good]
        if not len(x):
            return name[at]
        start = _starts(x)
        top = np.repeat(np.maximum.reduceat(gain, start), np.diff(np.append(start, len(x))))
        pair = np.where(gain == top, np.minimum(x, y) * k + np.maximum(x, y), k * k)
        pick = np.minimum.reduceat(pair, start)
        met, times = np.unique(pick, return_counts=True)
        met = met[times == 2]
        if not len(met):
            return name[at]
        to = np.arange(k)
        to[met % k] = met // k
        kept, place = np.unique(to, return_inverse=True)
        at, name = place[at], name[kept]
        u, v, w = _sums(place[u], place[v], w, len(kept))


def propagate_labels(a: np.ndarray, b: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The rounds of ``structural.propagate_labels``: per node its label, and the one before the last round."""
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    new = old = np.arange(n)
    for _ in range(rounds):
        old, key = new, np.sort(u * n + new[v])
        first = _starts(key)
        x, label, votes = key[first] // n, key[first] % n, np.diff(np.append(first, len(key)))
        start = _starts(x)
        top = np.repeat(np.maximum.reduceat(votes, start), np.diff(np.append(start, len(x))))
        new = np.minimum.reduceat(np.where(votes == top, label, n), start)  # every node has an edge
        if (new == old).all():
            break
    return new, old


def shortest_paths(start: np.ndarray, beside: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(through, far, met): Brandes' sums over the sources for each node, and for each source the
    sum of distances and the number of other nodes met. All sources go level by level at
    once; a pair of a source and a node is numbered source * n + node, under 2**31."""
    start, beside = start.astype(np.int32, copy=False), beside.astype(np.int32, copy=False)
    n, k = len(start) - 1, len(sources)
    depth, place = np.full(k * n, -1, np.int16 if n < 32_000 else np.int32), np.empty(k * n, np.int32)
    front = (np.arange(k) * n + sources).astype(np.int32)
    depth[front] = 0
    sigma, fronts, steps = [np.ones(k)], [front], []
    far, met = np.zeros(k, np.int64), np.zeros(k, np.int64)
    while True:
        front = fronts[-1]
        node = front % n
        count = start[node + 1] - start[node]
        at = np.repeat(start[node] - np.cumsum(count, dtype=np.int32) + count, count) + np.arange(count.sum(), dtype=np.int32)
        source = np.repeat(np.arange(len(front), dtype=np.int32), count)
        to = (front - node)[source] + beside[at]
        new = depth[to] < 0
        to, source = to[new], source[new]
        if not len(to):
            break
        depth[to] = len(fronts)
        nxt = np.flatnonzero(depth == len(fronts)).astype(np.int32)
        place[nxt] = np.arange(len(nxt))
        to = place[to]
        steps.append((source, to))
        sigma.append(np.bincount(to, sigma[-1][source], len(nxt)))
        each = np.bincount(nxt // n, minlength=k)
        far += len(fronts) * each
        met += each
        fronts.append(nxt)
    through, delta = np.zeros(n), np.zeros(len(fronts[-1]))
    for i in range(len(steps) - 1, -1, -1):
        source, to = steps[i]
        through += np.bincount(fronts[i + 1] % n, delta, n)
        delta = sigma[i] * np.bincount(source, ((1 + delta) / sigma[i + 1])[to], len(fronts[i]))
    return through, far, met
