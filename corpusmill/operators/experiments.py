"""Tables of experiments: intervention pairs, aligned corpora, dimensions of runs, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def intervention_pairs(quads: DataFrame, base: tuple[int, int] = (0, 1), source: tuple[int, int] = (1, 1), labels: tuple[str, ...] = ("relativizer", "the", "noun", "verb")) -> DataFrame:
    """A row for each quadruplet with both conditions (filler, gap) and each label: texts, first words after the gap, anchors.

    The labels name the last words before the gap from left to right; one grouped pass finds both conditions.
    """
    row = F.struct("sentence", "pre_gap_text", "post_gap_text")
    at = lambda c: F.first(F.when((F.col("filler") == c[0]) & (F.col("gap") == c[1]), row), ignorenulls=True)
    both = quads.groupBy("quadruplet_id").agg(at(base).alias("b"), at(source).alias("s")).where("b is not null and s is not null")
    n = len(labels)
    tail = lambda c: F.slice(T.words(c), F.greatest(F.size(T.words(c)) - n + 1, F.lit(1)), F.lit(n))
    zipped = F.arrays_zip(F.array(*map(F.lit, labels)).alias("position_label"), tail(F.col("b.pre_gap_text")).alias("base_anchor"), tail(F.col("s.pre_gap_text")).alias("source_anchor"))
    rows = both.select(
        "quadruplet_id", F.col("b.sentence").alias("base_text"), F.col("s.sentence").alias("source_text"), T.first_word(F.col("b.post_gap_text")).alias("yb"),
        T.first_word(F.col("s.post_gap_text")).alias("ys"), F.inline(zipped),
    )
    return rows.where("base_anchor is not null and source_anchor is not null")


def anchor_tokens(texts: DataFrame, key: str, text: str, anchor: str, strict: bool = True) -> DataFrame:
    """key and token_no, the white-space token that holds the whole-word anchor; null where it doesn't occur.

    Occurrences in different tokens are an error if strict, else the first counts.
    """
    quoted = F.concat(F.lit(r"(?<!\w)\Q"), F.col(anchor), F.lit(r"\E(?!\w)"))
    hits = F.transform(T.words(text), lambda w, i: F.when(F.regexp_like(w, quoted), i))
    kept = F.filter(hits, lambda i: i.isNotNull())
    first = F.array_min(kept)
    if strict:
        first = F.when(F.size(kept) > 1, F.raise_error(F.lit("the anchor is ambiguous"))).otherwise(first)
    return texts.select(key, first.cast("int").alias("token_no"))


def aligned(left: DataFrame, right: DataFrame, key: str = "pos") -> DataFrame:
    """Rows of two corpora joined by position; when the result is read, an error if one has a position that the other lacks. One join, no count beforehand."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full_outer")
    lacks = F.concat(F.lit("no partner at position "), F.col(key).cast("string"))
    checked = both.where(F.when(F.col("_l") & F.col("_r"), F.lit(True)).otherwise(F.raise_error(lacks).cast("boolean")))
    return checked.drop("_l", "_r")


def dimensions(**catalogues: DataFrame) -> DataFrame:
    """All combinations of the rows of small catalogues, whose columns take the catalogue's name in front."""
    out = None
    for name, rows in catalogues.items():
        named = rows.select(*(F.col(c).alias(f"{name}_{c}") for c in rows.columns))
        out = named if out is None else out.crossJoin(named)  # catalogues: a row per checkpoint, data set or layer; the planner knows their size
    if out is None:
        raise ValueError("no catalogue")
    return out


def not_done(candidates: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """The candidates whose keys aren't done."""
    return candidates.join(done.select(*keys).distinct(), list(keys), "left_anti")


def less_baseline(rows: DataFrame, baseline: DataFrame, *metrics: str) -> DataFrame:
    """rows with delta_ columns, the metrics less those of the one-row baseline."""
    named = baseline.select(*(F.col(m).alias(f"_{m}") for m in metrics))
    return rows.crossJoin(F.broadcast(named)).select(*rows.columns, *((F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics))


def decay(spark: SparkSession, start: float, rate: float, steps: int, least: float = 0.0) -> DataFrame:
    """step and temperature of a geometric schedule that ends at a floor."""
    return spark.range(steps).select(F.col("id").alias("step"), F.greatest(F.lit(start) * F.pow(F.lit(rate), F.col("id")), F.lit(least)).alias("temperature"))


def tasks(spark: SparkSession, models: list[str], evaluations: list[str]) -> DataFrame:
    """Task numbers from 0 with the model, number divided by the evaluations, and the evaluation, the remainder."""
    n = len(evaluations)
    rows = spark.range(len(models) * n).select(F.col("id").alias("task"))
    at = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    return rows.select("task", at(models, F.floor(F.col("task") / n)).alias("model"), at(evaluations, F.col("task") % n).alias("evaluation"))


def mixtures(spark: SparkSession, catalogue: dict[str, tuple[float, ...]], sources: tuple[str, ...]) -> DataFrame:
    """run, source, weight and share (of the run's weights) of the sources of each run whose weight is over 0."""
    rows = [(run, s, float(w), float(w) / sum(ws)) for run, ws in catalogue.items() for s, w in zip(sources, ws, strict=True) if w > 0]
    return spark.createDataFrame(rows, "run string, source string, weight double, share double")


def superseded(paths: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """paths with keep: whether it is the run's last checkpoint. What to do with the others is left to the caller."""
    last = paths.groupBy(run).agg(F.max(step).alias("_last"))
    return paths.join(last, run).withColumn("keep", F.col(step) == F.col("_last")).drop("_last")


def train_tag(name: Column | str) -> Column:
    """The tag in a training file's name: without train_ and _augmented, what follows _baseline_, train if nothing is left."""
    tag = T.col(name)
    tag = F.regexp_replace(F.regexp_replace(tag, "^train_", ""), "_augmented$", "")
    tag = F.when(tag.contains("_baseline_"), F.regexp_replace(tag, "^.*?_baseline_", "")).otherwise(F.regexp_replace(tag, "_baseline$", ""))
    return F.when(tag == "", "train").otherwise(tag)
