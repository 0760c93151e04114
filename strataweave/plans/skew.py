"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of the rows; so at most 1/HOT_SHARE keys are.
HOT_SHARE = 1 / 256
#: Keys that the counting sketch holds at a time: its counts are off by no more than 3.5 / SKETCH
#: of the rows, a ninth of HOT_SHARE.
SKETCH = 8192


def hot_keys(df: DataFrame, *keys: str) -> list[set[int]]:
    """Per key column the hashes of the values in more than HOT_SHARE of the rows (a few that
    come near it may be among them). One pass with a frequent-items sketch of fixed size for
    each partition, so neither a shuffle of the rows nor a table of all keys; what comes to
    the driver is at most 300 numbers a column. Null counts as a value."""
    tops = [F.expr(f"approx_top_k(xxhash64(`{k}`), 300, {SKETCH})").alias(f"t{i}") for i, k in enumerate(keys)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *tops).first()
    least = row["n"] * (HOT_SHARE - 3.5 / SKETCH)
    return [{x["item"] for x in row[f"t{i}"] if x["count"] > max(1, least)} for i in range(len(keys))]


def salts(key: str, hot: set[int], chunks: int, spread: list[str] | None) -> Column:
    """The chunk of a row of the large side (by the hash of ``spread``), or all chunks of a row
    of the other side; rows of keys that aren't hot have chunk 0."""
    is_hot = F.xxhash64(key).isin(*hot)
    if spread is not None:
        return F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(chunks)).cast("int")).otherwise(0)
    return F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(chunks - 1))).otherwise(F.array(F.lit(0))))


def join_spread(big: DataFrame, other: DataFrame, key: str, how: str = "inner", hot: set[int] | None = None) -> DataFrame:
    """Join on ``key`` where one key may have any share of the rows of ``big``.

    The rows of a hot key are spread over as many chunks as there are shuffle partitions and
    its rows of ``other`` are repeated for each; all other keys are shuffled once, as they
    are. ``how`` is ``inner`` or ``left``. Null keys match nothing. Columns besides ``key``
    must differ between the sides. ``hot`` is given where the caller has counted already;
    the same rule holds at every size.
    """
    rest = [c for c in other.columns if c != key]
    hot = hot_keys(big, key)[0] if hot is None else hot
    if not hot:
        return big.join(other, key, how).select(*big.columns, *rest)
    chunks = max(8, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = big.withColumn("__chunk", salts(key, hot, chunks, big.columns))
    right = other.withColumn("__chunk", salts(key, hot, chunks, None))
    return left.join(right, [key, "__chunk"], how).select(*big.columns, *rest)


def join_unique(big: DataFrame, small: DataFrame, key: str, how: str = "inner", hot: set[int] | None = None) -> DataFrame:
    """``join_spread`` with a side in which ``key`` is unique, so what is repeated is at most
    1/HOT_SHARE rows a chunk."""
    return join_spread(big, small, key, how, hot)
