"""Ablation of units of vectors: how well vectors are told apart by label when some of their units are silenced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label and centroid, the mean of each unit over the vectors of the label; rows without label or vector don't count."""
    units = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("unit", "x"))
    means = units.groupBy("label", "unit").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "m"))), lambda s: s["m"]).alias("centroid"))  # units


def scored(vectors: DataFrame, conditions: dict[str, list[int]], key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """condition, n, accuracy and delta_accuracy of the nearest centroid, with the units of each condition set to zero; delta is against the condition '', nothing silenced, which is always there.

    Centroids are those of whole vectors; of equally near ones the smaller label counts. Labels are few: their centroids are one row.
    """
    whole = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.transform(vector, lambda x: x.cast("double")).alias("_x"))
    listed = stored(centroids(vectors, label, vector), "centroids").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_c"))
    cases = F.array(*(F.struct(F.lit(name).alias("condition"), F.array(*map(F.lit, units)).cast("array<int>").alias("units")) for name, units in {"": [], **conditions}.items()))
    rows = whole.join(F.broadcast(listed)).select("_label", "_x", "_c", F.explode(cases).alias("_case"))
    silenced = F.transform("_x", lambda x, i: F.when(F.array_contains("_case.units", i), F.lit(0.0)).otherwise(x))
    rows = rows.withColumn("_x", silenced)
    far = lambda c: F.aggregate(F.zip_with("_x", c["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x)
    nearest = F.array_min(F.transform("_c", lambda c: F.struct(far(c).alias("far"), c["label"].alias("label"))))
    per = rows.groupBy("_case.condition").agg(F.count(F.lit(1)).alias("n"), F.avg((nearest["label"] == F.col("_label")).cast("double")).alias("accuracy"))
    per = stored(per, "ablation")
    whole_accuracy = per.where("condition = ''").select(F.col("accuracy").alias("_whole"))
    return per.join(F.broadcast(whole_accuracy)).select("condition", "n", "accuracy", (F.col("accuracy") - F.col("_whole")).alias("delta_accuracy"))
