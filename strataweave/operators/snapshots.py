"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def _canonical(df: DataFrame, name: str) -> Column:
    """A column in a form in which equal values are equal text: maps as sorted
    entries, -0.0 as 0.0."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(c))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string")
    return c


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns' values; null differs from every value and equals null."""
    return F.unhex(F.sha2(F.to_json(F.struct(*(_canonical(df, c).alias(f"c{i}") for i, c in enumerate(columns)))), 256))


def snapshot_changes(
    snapshots: DataFrame,
    versions: DataFrame,
    key: str = "entity_id",
    version: str = "version_id",
    order: str = "created_at",
    recency: str = "loaded_at",
    compared: tuple[str, ...] = ("label", "node_type", "description", "confidence", "props"),
) -> DataFrame:
    """(version_from, version_to, key, change_kind) for each version and the next by ``order``.

    Both sides of all pairs are one union tagged by side; one aggregation by (pair, key)
    takes the newest row hash of each side and classifies. Partial aggregation makes a
    key with any number of rows cheap. Rows with a null key or an unlisted version are
    left out; repeated rows count once; of rows with equal ``recency`` the larger hash
    counts; a null ``recency`` is the oldest. A listed version without rows is an empty
    snapshot. Empty tables give an empty result. Other columns are not read.
    """
    seq = versions.select(F.col(version).alias("version_id"), F.col(order).alias("__o")).where("version_id is not null").distinct()
    w = W.orderBy(F.col("__o").asc_nulls_first(), "version_id")  # a few rows: one per delivery
    seq = seq.withColumn("__next", F.lead("version_id").over(w)).withColumn("__prev", F.lag("version_id").over(w))
    sides = seq.select(
        F.col("version_id").alias("__v"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("version_id").alias("f"), F.col("__next").alias("t"), F.lit(0).alias("side")),
                    F.struct(F.col("__prev").alias("f"), F.col("version_id").alias("t"), F.lit(1).alias("side")),
                ),
                lambda s: s["f"].isNotNull() & s["t"].isNotNull(),
            )
        ).alias("s"),
    )
    rows = snapshots.where(F.col(key).isNotNull()).select(
        F.col(version).alias("__v"), F.col(key).alias("__k"), F.struct(F.col(recency).alias("at"), row_hash(snapshots, list(compared)).alias("h")).alias("__r")
    )
    tagged = rows.join(sides, "__v")
    last = lambda side: F.max(F.when(F.col("s.side") == side, F.col("__r")))["h"]
    both = tagged.groupBy("s.f", "s.t", "__k").agg(last(0).alias("__a"), last(1).alias("__b"))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(F.col("f").alias("version_from"), F.col("t").alias("version_to"), F.col("__k").alias(key), kind.alias("change_kind")).where("change_kind is not null")


def version_diff(changes: DataFrame, key: str = "entity_id", list_limit: int | None = None) -> DataFrame:
    """Counts of each kind for every pair of versions that differ."""
    n = lambda k: F.count(F.when(F.col("change_kind") == k, 1))
    return changes.groupBy("version_from", "version_to").agg(n("added").alias("n_added"), n("removed").alias("n_removed"), n("changed").alias("n_changed"))
