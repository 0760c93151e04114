"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.bytes_of_text import code_points, is_space

#: Strength of a cut before a character; 0 is inside a word.
WORD, CLAUSE, LINE, SENTENCE, PARAGRAPH = 1, 2, 3, 4, 5
KINDS = {0: "forced", 1: "word", 2: "clause", 3: "line", 4: "sentence", 5: "paragraph"}

# Words that end with a full stop inside a sentence.
ABBREVIATIONS = frozenset("abs art nr bzw ca d h z b vgl tab anh kap abb dr prof ing st mio mrd usw e g i no fig sec cf vs inc ltd al p pp etc ref".split())

PIECES = "piece_no int, start_char long, end_char long, cut_kind string, piece string, cut_run long"


def boundary_strengths(cp: np.ndarray) -> np.ndarray:
    """Strength of the cut before each place 0..n of a text of n code points."""
    n = len(cp)
    s = np.zeros(n + 1, np.int8)
    if n == 0:
        return s
    sp, nl = is_space(cp), cp == 10
    at = np.flatnonzero(sp[:-1] & ~sp[1:]) + 1  # first character after white space
    s[at] = WORD
    run = np.cumsum(sp)
    prev = np.where(sp, 0, np.arange(n))  # index of the last character that isn't white space
    prev = np.maximum.accumulate(prev)
    before = prev[at - 1]
    last = cp[before]
    s[at[np.isin(last, [44, 59, 58])]] = CLAUSE
    lines = np.concatenate(([0], np.cumsum(nl)))
    n_nl = lines[at] - lines[before + 1]
    nxt = cp[at]
    upper = (nxt >= 65) & (nxt <= 90) | (nxt >= 192) & (nxt <= 222) | np.isin(nxt, [34, 40, 171, 191, 161, 8222, 8220, 91])
    stop = np.isin(last, [33, 63, 8230]) | np.isin(last, [46]) & upper
    stop |= np.isin(last, [34, 41, 187, 8220, 8221]) & np.isin(cp[np.maximum(before - 1, 0)], [46, 33, 63]) & upper
    for i in np.flatnonzero(stop & (last == 46)):
        e = b = int(before[i])
        while b > 0 and e - b < 6 and not sp[b - 1]:
            b -= 1
        w = "".join(map(chr, cp[b:e])).lower()
        if w in ABBREVIATIONS or len(w) == 1 or "." in w:
            stop[i] = False
    s[at[n_nl == 1]] = LINE
    s[at[stop]] = SENTENCE
    s[at[n_nl >= 2]] = PARAGRAPH
    del run
    return s


class StrongestCut:
    """Sparse-table range-maximum index over ``strengths[lo:hi]``: ``query(a, b)`` is the
    place of the strongest cut in a..b, the rightmost of equals."""

    def __init__(self, strengths: np.ndarray, lo: int, hi: int, longest: int):
        m = hi - lo
        key = strengths[lo:hi].astype(np.int64) * m + np.arange(m)  # strength first, then the right
        self.lo, self.m, self.levels, width = lo, m, [key], 1
        while width * 2 <= min(longest, m):
            key = np.maximum(key[:-width], key[width:])
            self.levels.append(key)
            width *= 2

    def query(self, a: int, b: int) -> tuple[int, int]:
        k = (b - a + 1).bit_length() - 1
        key = max(self.levels[k][a - self.lo], self.levels[k][b - self.lo - (1 << k) + 1])
        return int(key) % self.m + self.lo, int(key) // self.m


def cut_places(strengths: np.ndarray, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) of the pieces: none longer than ``size``,
    consecutive ones sharing ``overlap`` characters. Each end is the strongest cut of the
    whole permissible window, the rightmost of equals; without any, the window's end."""
    n, out, start, index = len(strengths) - 1, [], 0, None
    overlap = max(0, min(overlap, size - 1))
    segment = max(1 << 16, 8 * size)
    while n - start > size:
        if index is None or start + size >= index.lo + index.m:
            index = StrongestCut(strengths, start, min(n + 1, start + segment + size + 1), size + 1)
        cut, strength = index.query(start + overlap + 1, start + size)
        out.append((start, cut, strength))
        start = cut - overlap
    out.append((start, n, PARAGRAPH))
    return out


class Runs:
    """Runs of characters without white space: ``length(i)`` of the one that goes across place i."""

    def __init__(self, cp: np.ndarray):
        self.spaces, self.n = np.flatnonzero(is_space(cp)), len(cp)

    def length(self, i: int) -> int:
        k = int(np.searchsorted(self.spaces, i))
        before = int(self.spaces[k - 1]) if k else -1
        after = int(self.spaces[k]) if k < len(self.spaces) else self.n
        return after - before - 1


def split_texts(df: DataFrame, key: str, text: str, size: str, overlap: str, with_text: bool = True) -> DataFrame:
    """One row per piece of each text, in one narrow pass (no shuffle).

    ``size`` and ``overlap`` are int columns in characters. Texts within their size come
    out as one piece; an empty text as one empty piece; null texts give no row. A null or
    non-positive size or a null or negative overlap is an error of the caller's defaults
    and takes 1024 and 100. An overlap of the size or more is cut to size - 1. Every text
    is processed whole; the index covers one segment at a time, so memory stays flat for
    very long texts. Columns: key, piece_no, start_char, end_char, cut_kind (what the end
    is), piece (null unless ``with_text``) and cut_run: for a forced cut, the length of the
    run of characters without white space that it cuts, else 0.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for k, t, z, o in zip(*(b.column(i).to_pylist() for i in range(4))):
                if t is None:
                    continue
                z = z if z and z > 0 else 1024
                o = o if o is not None and o >= 0 else 100
                cp = code_points(t)
                n = len(cp)
                parts, runs = ([(0, n, PARAGRAPH)], None) if n <= z else (cut_places(boundary_strengths(cp), z, o), Runs(cp))
                for i, (s, e, w) in enumerate(parts):
                    run_cut = runs.length(e) if w == 0 and runs else 0
                    for c, v in zip(cols, (k, i, s, e, "end" if i == len(parts) - 1 else KINDS[w], t[s:e] if with_text else None, run_cut)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"`{key}` {kind}, {PIECES}"
    out = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(F.col(key), F.col(text), F.col(size).cast("int"), F.col(overlap).cast("int")).mapInArrow(run, schema)


def with_config(docs: DataFrame, configs: DataFrame, name: str = "config_name", default: str = "default", size: int = 1024, overlap: int = 100) -> DataFrame:
    """``docs`` with __size and __overlap of their configuration; a null name means
    ``default``, null or unknown sizes mean the defaults."""
    conf = configs.select(F.col(name).alias("__c"), F.col("chunk_size").alias("__s"), F.col("chunk_overlap").alias("__o")).where("__c is not null").groupBy("__c").agg(F.max("__s").alias("__s"), F.max("__o").alias("__o"))
    d = docs.withColumn("__c", F.coalesce(F.col(name), F.lit(default)))
    return d.join(conf, "__c", "left").withColumn("__size", F.coalesce("__s", F.lit(size))).withColumn("__overlap", F.coalesce("__o", F.lit(overlap))).drop("__c", "__s", "__o")
