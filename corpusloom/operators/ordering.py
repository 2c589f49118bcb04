"""Order-dependent operators that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position(df: DataFrame, keys: list[str], order: str, out: str, width: int = 65_536) -> DataFrame:
    """1-based position of each row within its keys by a unique integer column; rows without one come first.

    Rows are numbered inside (keys, order div width); the counts of earlier blocks are added from a small table, so a hot key is
    spread over its blocks instead of being sorted in one task.
    """
    block = F.floor(F.col(order) / width)
    cut = df.withColumn("__block", block)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys, "__block").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order))
    # Null keys and nulls of the order column are values like any other: the counts are joined null-safe.
    named = [*keys, "__block"]
    offsets = offsets.select(*(F.col(c).alias(f"__of_{c}") for c in named), "__before")
    met = cut.withColumn("__inside", inside)
    same = F.lit(True)
    for c in named:
        same = same & met[c].eqNullSafe(offsets[f"__of_{c}"])
    return met.join(offsets, same).drop(*(f"__of_{c}" for c in named)).withColumn(out, (F.col("__inside") + F.col("__before")).cast("long")).drop("__block", "__inside", "__before")


def running_max(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = 65_536) -> DataFrame:
    """Adds the largest value at or before each row, by an integer column that is unique within its keys.

    As in ``position``, windows hold one block of a key, and what earlier blocks of it had is joined from a small table: only keys with
    several blocks have rows there.
    """
    cut = df.withColumn("__block", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "__block").agg(*(F.max(v).alias(f"__top_{c}") for c, v in values.items()))
    carried = blocks.select(*keys, "__block", F.lag("__block").over(Window.partitionBy(*keys).orderBy("__block")).alias("__last"), *(F.max(f"__top_{c}").over(before).alias(f"__of_{c}") for c in values)).where("__last is not null").drop("__last")
    met = cut.select("*", *(F.max(v).over(inside).alias(f"__in_{c}") for c, v in values.items())).join(carried, [*keys, "__block"], "left")
    return met.select(*df.columns, *(F.greatest(f"__in_{c}", f"__of_{c}").alias(c) for c in values))


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row per key as one aggregation (combined before the shuffle), not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, "__row.*")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First k rows per key; Spark limits each task to k rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def fill_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, before_only: bool = False) -> DataFrame:
    """Last non-null value at or before (or strictly before) each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before_only else 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return top_k(df, keys, 1, *order, rank="__rank").drop("__rank")
