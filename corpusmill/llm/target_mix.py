"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. The rows of each source are sorted by that key in ranges of equal width, as many as the source's
share of the rows asks for, so that a hot source lies in many. Prefix sums of sizes are taken in each range, and one row per range gives what lies before
it. Whole epochs of a source are taken as often as its budget holds them; the last one is cut where the prefix sum meets the budget,
inside a document if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import joined_hot, stored, table

#: Weights of the sources in order of name, repeating; share of all sizes that is asked for; times that a source is repeated at most.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
SEED = "mix"
#: Ranges for each shuffle partition of the session, over all sources.
RANGES = 8
#: Hexadecimal digits of a key.
DIGITS = 15
WORD = r"[^\x20\x09-\x0D]+"
#: Copies of a row that are dealt out again at a time.
COPIES = 1 << 16


def random_key(seed: str, key: Column) -> Column:
    """A number under 2^60, the first digits of the md5 of seed and key: alike at every run. A null key counts as ''."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long")


def _places(sources: DataFrame) -> DataFrame:
    """sources with place, their running number from 0 by code point, null last, counted in ranges of names."""
    spark = sources.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "mix-places")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", (before - F.col("_first")).alias("_base"))  # a row for each range
    return ranged.join(F.broadcast(bases), "_part").withColumn("place", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size and more, one row each) with weight and target.

    share of all sizes is dealt out by weight; a target stops at epochs times its source's size, and what is over is dealt again by weight to the
    others until none is above. Each round is an aggregation over the sources; what the driver sees is its three sums.
    """
    cases = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    sources = stored(_places(sources).withColumn("weight", cases).drop("place"), "mix-sources")
    most = F.col("source_size") * epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, full = None, -1
    while True:
        over = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > most
        n, capped, weight = sources.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not weight:
            break
        rate, full = (share * total - (capped or 0)) / weight, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(rate or 0)), most.cast("double")))


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, taken, start.

    size is the number of words unless a column of sizes (long) is given; null texts have none. Null is a source of its own, after all others; '' is a
    source like any other. start is the number of words of its source that come before the row in random order. taken sums up to the
    target, rounded half up, for each source; a row is taken epochs times at most. Rows that repeat are rows of their own: they are counted once
    where they are, stand next to each other in the order, and are dealt out again at the end. Null ids are one id. Sources without a word have target 0. An empty
    table gives no rows. Columns other than the three named ones (and those of size) are not read.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long") if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # null too can be joined on
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), name.alias("_source"), words.alias("size"))
    rows = stored(rows.groupBy("_source", "source", "doc_id", "size").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_key", random_key(seed, F.col("doc_id"))), "mix-rows")

    held = rows.groupBy("_source", "source").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = stored(targets(held, weights, share, epochs), "mix-targets")
    total = rows.count()
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sources = sources.withColumn("_ranges", F.ceil(F.col("_rows") * F.lit(ranges) / F.lit(max(1, total))))
    rows = joined_hot(rows, sources.drop("source", "weight"), ["_source"], "_rows", total)
    half = 2 * DIGITS  # of a key's bits: the product stays within a long
    rows = rows.withColumn("_range", F.shiftright(F.shiftright("_key", half) * F.col("_ranges"), half))

    sums = rows.groupBy("_source", "_range").agg(F.sum(F.col("size") * F.col("_copies")).alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_source", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(bases.hint("merge"), ["_source", "_range"]).withColumn("_before", F.col("_base") + F.coalesce(F.sum(F.col("size") * F.col("_copies")).over(inside), F.lit(0)))

    # Copies come back in two steps, so that no array is longer than COPIES.
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    dealt = placed.withColumn("_lot", up_to(F.ceil(F.col("_copies") / F.lit(COPIES))))
    dealt = dealt.withColumn("_copy", up_to(F.least(F.lit(COPIES).cast("long"), F.col("_copies") - F.col("_lot") * COPIES)))
    budget = F.floor(F.col("target") + F.lit(0.5))
    times = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0).cast("long"))
    start = F.col("_before") + (F.col("_lot") * COPIES + F.col("_copy")) * F.col("size")
    rest = F.col("_budget") - F.col("_times") * F.col("source_size") - F.col("start")
    dealt = dealt.withColumns({"_budget": budget, "start": start}).withColumn("_times", times)
    taken = F.col("_times") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return dealt.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "start")


def op13_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each row of documents is taken into a mix of one and a half times the table; see mixed() for nulls and repeats."""
    return mixed(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(sum(size)) OVER () AS BIGINT) AS total,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size / weight AS full_at,
    CAST(coalesce(sum(2 * source_size) OVER lower, 0) AS BIGINT) AS capped, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0) AS BIGINT) AS open
    FROM s WINDOW lower AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT coalesce(max((1.5::DOUBLE * total - capped) / open) FILTER (WHERE weight * ((1.5::DOUBLE * total - capped) / open) <= 2 * source_size), 0) AS rate FROM f),
t AS (SELECT source, source_size, least(weight * rate, CAST(2 * source_size AS DOUBLE)) AS target FROM s, r),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) END AS taken, start FROM p
"""
