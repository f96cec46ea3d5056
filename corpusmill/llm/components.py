"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, stored


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (u, v) with m, the smallest of u and all v of that u. A hub's pairs stay where they are: joined_hot()."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return joined_hot(pairs, least, ["u"], "n", total)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down, n)
    return linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """For each node of edges (u, v) that isn't the smallest of its component: node, root (the smallest).

    Each step is written to the shared folder. It ends when a round changes nothing; rounds grow with the logarithm of the
    longest path.
    """
    edges = stored(edges.where("u <> v").distinct(), "edges")
    now = _state(edges)
    while True:
        before = now
        large = stored(_large_star(edges, now[0]), "large-star")
        edges = stored(_small_star(large, large.count()), "small-star")
        now = _state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
