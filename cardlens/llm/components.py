"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, tables: Tables, prefix: str) -> DataFrame:
    """``edges(a, b)`` -> ``(node, label)``, label = smallest node of the component.

    Each round points every larger neighbour at the smallest one (large star)
    and then every node at its smallest smaller neighbour (small star), which
    needs O(log^2 n) rounds whatever the diameter.  Both are grouped minima
    (summed before the shuffle) joined back; the minima are written first, so
    a node with very many neighbours is split by the adaptive skew join.
    Self loops, repeated and reversed edges are harmless; no edges, no rows."""
    at = f"{prefix}-0"
    now = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct(), at)
    step = 0
    while True:
        seen = _state(now)
        if not seen[0]:
            break
        for star in (_large_star, _small_star):
            step += 1
            low = f"{prefix}-{step}-low"
            after = tables.write(star(now, tables, low, seen[0]), f"{prefix}-{step}", seen[0])
            tables.drop(low, at)
            now, at = after, f"{prefix}-{step}"
        if _state(now) == seen:
            break
    children = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return children.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, tables: Tables, name: str, n: int) -> DataFrame:
    near = _both_ways(edges)
    low = tables.write(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name, 2 * n)
    return (near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame, tables: Tables, name: str, n: int) -> DataFrame:
    low = tables.write(edges.groupBy("a").agg(F.min("b").alias("m")), name, n)
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
