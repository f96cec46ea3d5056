"""Kernel densities over a grid: values are binned once, the rest is array arithmetic on a row for each group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def gaussian(rows: DataFrame, value: str, by: str, points: int = 200, cut: float = 3.0, adjust: float = 1.0) -> DataFrame:
    """by, point (0 to points - 1), x and density: a Gaussian kernel density of value in each group, on one grid that reaches cut bandwidths beyond all groups.

    The bandwidth is Scott's, the sample deviation times n^(-1/5), times adjust. A value is shared between the two grid points around it in proportion, so
    every value counts and the cost of the convolution is that of the grid. Null, NaN and infinite values don't count; null is a group. A group of
    fewer than two different values has no density and is left out.
    """
    if points < 2:
        raise ValueError("a grid has two points at least")
    clean = rows.select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")).where(_finite(F.col("_v")))
    groups = clean.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_least"), F.max("_v").alias("_most")).where("_sd > 0")
    groups = stored(groups.withColumn("_width", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * adjust), "density-groups")
    ends = groups.agg(F.min(F.col("_least") - cut * F.col("_width")).alias("_low"), F.max(F.col("_most") + cut * F.col("_width")).alias("_high"))
    grid = ends.select("_low", ((F.col("_high") - F.col("_low")) / (points - 1)).alias("_step"))  # one row
    place = (F.col("_v") - F.col("_low")) / F.col("_step")
    at = clean.join(F.broadcast(grid)).select("_by", place.alias("_place"), F.least(F.floor(place), F.lit(points - 2)).cast("int").alias("_bin"))
    bins = at.groupBy("_by", "_bin").agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col("_place") - F.col("_bin")).alias("_right"))
    held = bins.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("_bin", "_all", "_right"))).alias("_bins"))  # points - 1 entries at most
    one = groups.join(held, groups["_by"].eqNullSafe(held["_by"])).drop(held["_by"]).join(F.broadcast(grid))
    far = lambda d: F.exp(-F.pow(d * F.col("_step") / F.col("_width"), F.lit(2.0)) / 2)
    one = one.withColumn("_kernel", F.transform(F.sequence(F.lit(0), F.lit(points)), lambda d: far(d.cast("double"))))
    kernel = lambda d: F.element_at("_kernel", F.abs(d).cast("int") + 1)
    share = lambda j, e: (e["_all"] - e["_right"]) * kernel(j - e["_bin"]) + e["_right"] * kernel(j - e["_bin"] - 1)
    height = lambda j: F.aggregate("_bins", F.lit(0.0), lambda total, e: total + share(j, e))
    curve = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda j: height(j) / (F.col("_n") * F.col("_width") * math.sqrt(2 * math.pi)))
    drawn = one.select("_by", "_low", "_step", F.posexplode(curve).alias("point", "density"))
    return drawn.select(F.col("_by").alias(by), "point", (F.col("_low") + F.col("point") * F.col("_step")).alias("x"), "density")


def overlap(densities: DataFrame, by: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """left, right and overlap of each pair of groups: the area under the lower of their two densities on the grid, 0 where they are apart, about 1 where they are alike."""
    if not pairs:
        raise ValueError("no pairs")
    listed = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs))
    sides = densities.select(F.col(by).cast("string").alias("_by"), "point", "x", "density", F.explode(listed).alias("_pair"))
    both = sides.where((F.col("_by") == F.col("_pair.left")) | (F.col("_by") == F.col("_pair.right"))).groupBy("_pair", "point", "x").agg(F.min("density").alias("_lower"), F.count_distinct("_by").alias("_groups"))
    same = F.col("_pair.left") == F.col("_pair.right")
    lower = F.when((F.col("_groups") == 2) | same, F.col("_lower")).otherwise(0.0)
    area = both.groupBy("_pair").agg(F.sum(lower).alias("_sum"), ((F.max("x") - F.min("x")) / (F.count(F.lit(1)) - 1)).alias("_step"))
    return area.select("_pair.left", "_pair.right", (F.col("_sum") * F.col("_step")).alias("overlap"))
