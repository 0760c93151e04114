"""Token counts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Path of a ``.tiktoken`` file of ranks; a parameter of every operator that counts tokens.
DEFAULT_VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_KNOWN_LIMIT = 2_000_000


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_batch(texts: pa.Array, path: str, known: dict[str, int]) -> np.ndarray:
    """Exact token count of each text (null and empty: 0).

    No pre-token spans a place between a character that isn't white space and a blank
    after it, so a text without double blanks is cut at its blanks and each distinct
    unit is encoded once. Other texts are encoded whole.
    """
    enc = encoder(path)
    texts = pc.fill_null(texts, "")
    whole = np.asarray(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))).to_numpy(zero_copy_only=False), bool)
    out = np.zeros(len(texts), np.int64)
    if whole.any():
        at = np.flatnonzero(whole)
        out[at] = [len(enc.encode_ordinary(t)) for t in texts.take(pa.array(at)).to_pylist()]
    rest = np.flatnonzero(~whole)
    if len(rest):
        parts = pc.split_pattern(texts.take(pa.array(rest)), " ")
        off = np.asarray(parts.offsets).astype(np.int64)
        off = off - off[0]
        d = parts.flatten().dictionary_encode()
        codes, units = d.indices.to_numpy(), d.dictionary.to_pylist()
        if len(known) > _KNOWN_LIMIT:
            known.clear()
        n_first = np.empty(len(units), np.int64)  # at the start of a text, without the blank before it
        n_later = np.empty(len(units), np.int64)
        first = np.zeros(len(units), bool)
        first[codes[off[:-1]]] = True
        for i, u in enumerate(units):
            k = known.get(u)
            if k is None:
                k = known[u] = len(enc.encode_ordinary(" " + u))
            n_later[i] = k
            n_first[i] = len(enc.encode_ordinary(u)) if first[i] else 0
        each = n_later[codes]
        each[off[:-1]] = n_first[codes[off[:-1]]]
        total = np.concatenate(([0], np.cumsum(each)))
        out[rest] = total[off[1:]] - total[off[:-1]]
    return out


def with_token_count(df: DataFrame, keep: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the token count of ``text``: one narrow Arrow pass, after
    which the text is gone. A null or empty text has 0 tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    slim = df.select(*keep, F.col(text).alias("__text"))
    out = StructType([*(slim.schema[c] for c in keep), StructField(name, LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            n = count_batch(b.column(len(keep)), path, known)
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(arrow.field(i).type) for i in range(len(keep))), pa.array(n)], schema=arrow)

    return slim.mapInArrow(run, out)
