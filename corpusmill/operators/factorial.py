"""2 x 2 factorial statistics over items with four cells: filler 0/1 by gap 0/1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

CELLS = {"wh_gap": (1, 1), "wh_no_gap": (1, 0), "no_wh_gap": (0, 1), "no_wh_no_gap": (0, 0)}


def _in(cell: str) -> Column:
    filler, gap = CELLS[cell]
    return (F.col("filler") == filler) & (F.col("gap") == gap)


def cell_name() -> Column:
    out = F.lit(None).cast("string")
    for cell in CELLS:
        out = F.when(_in(cell), F.lit(cell)).otherwise(out)
    return out


def valid(y: str = "y") -> Column:
    """y is a number: neither null nor NaN."""
    return F.col(y).isNotNull() & ~F.isnan(y)


def pivoted(rows: DataFrame, item: str = "item", y: str = "y") -> DataFrame:
    """One row per item with the mean of each cell; null where the item lacks it."""
    return rows.where(valid(y)).groupBy(item).agg(*(F.avg(F.when(_in(c), F.col(y))).alias(c) for c in CELLS))


def complete(wide: DataFrame) -> DataFrame:
    return wide.dropna(subset=list(CELLS))


def interaction() -> Column:
    """(filler, no gap - no filler, no gap) - (filler, gap - no filler, gap)."""
    return (F.col("wh_no_gap") - F.col("no_wh_no_gap")) - (F.col("wh_gap") - F.col("no_wh_gap"))


def cell_means(rows: DataFrame, y: str = "y") -> DataFrame:
    """One row: the cells' means over all rows, NaN and null skipped, and the interaction of the means."""
    return rows.where(valid(y)).agg(*(F.avg(F.when(_in(c), F.col(y))).alias(c) for c in CELLS)).withColumn("interaction", interaction())


def centred(rows: DataFrame, item: str = "item", y: str = "y") -> DataFrame:
    """rows with y_centred, y less the mean of its item."""
    return rows.withColumn("y_centred", F.col(y) - F.avg(y).over(Window.partitionBy(item)))


def accuracy(rows: DataFrame, item: str = "item", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """n items with all cells, how many have an interaction over 0, its mean and sample deviation, and the cells' means: one row, or one for each group of by."""
    score = interaction()
    wide = rows.where(valid(y)).groupBy(*by, item).agg(*(F.avg(F.when(_in(c), F.col(y))).alias(c) for c in CELLS))
    return complete(wide).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((score > 0).cast("double")).alias("accuracy"), F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"),
        *(F.avg(c).alias(c) for c in CELLS),
    )


def mixed_model(rows: DataFrame, item: str = "item", y: str = "y") -> DataFrame:
    """The model y ~ filler * gap + (1 | item), filler and gap coded -0.5 and 0.5, by REML in closed form.

    Works on items with all four cells, a value each (the mean of several); the others are counted in n_dropped. One row: n_items,
    n_dropped, the four estimates, their standard errors and z values, sigma2, licensing (the negative of the
    interaction) with its 95 % bounds.
    """
    wide = pivoted(rows, item, y)
    c11, c10, c01, c00 = (F.col(c) for c in CELLS)
    sums = wide.withColumn("_full", F.when((c11 + c10 + c01 + c00).isNotNull(), 1).otherwise(0))
    mean = (c11 + c10 + c01 + c00) / 4
    full = F.col("_full") == 1
    a = sums.agg(F.sum("_full").alias("n"), F.sum(1 - F.col("_full")).alias("n_dropped"), *(F.avg(F.when(full, F.col(c))).alias(f"m_{c}") for c in CELLS))
    spread = complete(wide).join(F.broadcast(a))  # one row
    grand = (F.col("m_wh_gap") + F.col("m_wh_no_gap") + F.col("m_no_wh_gap") + F.col("m_no_wh_no_gap")) / 4
    within = sum(((F.col(c) - mean - (F.col(f"m_{c}") - grand)) ** 2 for c in CELLS), F.lit(0.0))
    s = spread.groupBy("n", "n_dropped", *(f"m_{c}" for c in CELLS)).agg(F.sum(within).alias("ss_w"), F.sum((mean - grand) ** 2 * 4).alias("ss_b"))
    n = F.col("n").cast("double")
    ms_w, ms_b = F.col("ss_w") / (3 * (n - 1)), F.col("ss_b") / (n - 1)
    pooled = (F.col("ss_w") + F.col("ss_b")) / (4 * n - 4)
    d11, d10, d01, d00 = (F.col(f"m_{c}") for c in CELLS)
    sigma2 = F.when(ms_b > ms_w, ms_w).otherwise(pooled)
    s = s.select(
        F.col("n").alias("n_items"), "n_dropped", grand.alias("b_0"), ((d11 + d10 - d01 - d00) / 2).alias("b_filler"), ((d11 + d01 - d10 - d00) / 2).alias("b_gap"),
        (d11 - d10 - d01 + d00).alias("b_interaction"), F.sqrt(F.when(ms_b > ms_w, ms_b).otherwise(pooled) / (4 * n)).alias("se_0"),
        F.sqrt(sigma2 / n).alias("se_main"), F.sqrt(4 * sigma2 / n).alias("se_interaction"), sigma2.alias("sigma2"),
    )
    reach = F.col("se_interaction") * stats.Z975
    return s.withColumns(
        {
            "z_filler": F.col("b_filler") / F.col("se_main"), "z_gap": F.col("b_gap") / F.col("se_main"), "z_interaction": F.col("b_interaction") / F.col("se_interaction"),
            "licensing": -F.col("b_interaction"), "licensing_low": -F.col("b_interaction") - reach, "licensing_high": -F.col("b_interaction") + reach,
        }
    )


def within_item_interval(rows: DataFrame, item: str = "item", y: str = "y", level: float = 0.95) -> DataFrame:
    """One row: n complete items, the mean interaction per item, its standard error and confidence bounds from the t distribution."""
    per = complete(pivoted(rows, item, y)).select(interaction().alias("i"))
    out = per.agg(F.count(F.lit(1)).alias("n"), F.avg("i").alias("mean"), (F.stddev_samp("i") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"))
    reach = stats.t_quantile(F.lit((1 + level) / 2), (F.col("n") - 1).cast("double")) * F.col("se")
    return out.withColumn("low", F.col("mean") - reach).withColumn("high", F.col("mean") + reach)


def token_profile(rows: DataFrame, value: str = "surprisal") -> DataFrame:
    """Mean and population deviation by condition, length of the item and position, with the token of the first item there.

    rows may say in length how many tokens their item has; else they are counted.
    """
    length = rows if "length" in rows.columns else rows.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("item", "cond")))
    return length.groupBy("cond", "length", "tok_pos").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min_by("token", "item").alias("token")
    )


def first_and_mean(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The first and the mean surprisal in nats of each suffix, from logp by tok_pos."""
    return tokens.groupBy(*keys).agg((-F.min_by("logp", "tok_pos")).alias("surprisal_first"), (-F.avg("logp")).alias("surprisal_mean"))


def post_gap(post: Column, sentence: Column, pre: Column) -> Column:
    """What follows the gap; the rest of the sentence where that is empty."""
    return F.when(F.coalesce(post, F.lit("")) == "", F.trim(F.substr(sentence, F.length(pre) + 1))).otherwise(post)
