"""Connected components of an edge table, by alternating large-star and small-star steps (a distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _toward_min(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _toward_min(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge in (u, v); the root is the least node of its component.

    Both steps only ever replace an edge's end by a smaller node of the same component, so a hub's edges are split by
    the join and its least neighbour is pre-aggregated. It ends when a double step changes nothing.
    """
    clean = lambda e: e.where("u <> v").distinct()
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = written(clean(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    last = sign(edges)
    while last[0]:
        edges = written(clean(_small_star(clean(_large_star(edges)))))
        now = sign(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
