"""Connected components of a link table, as alternating star contractions (no driver-side state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import drop, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node that it reaches.

    Returns ``(node, component)``; nodes without links don't appear. Null ends, loops and repeated links
    are ignored; an empty table gives an empty result. Each round is written to the shared folder, so a
    lost executor costs that round at most. The graph is a forest of stars exactly when no node has two
    parents and no parent has a parent, which ends the loop.
    """
    links = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        before, links = links, materialize(_small_star(_large_star(links)), "stars")
        drop(before)
        two = links.groupBy("a").count().where("count > 1").limit(1)
        deep = links.join(links.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if two.select("a").unionByName(deep.select("a")).isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
