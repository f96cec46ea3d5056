"""Evaluators dispatched over a catalogue that comes in as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry
from ..sources.tables import new_folder
from .base import table
from .catalog import query

_Y = "l_quantity + l_orderkey % 13"


def _tables(spark: SparkSession, d: str) -> dict[str, str]:
    """Tables of results, made of the driver's, by the evaluator that reads them; one lacks a column, one isn't there."""
    lines, events, vectors = table(spark, d, "lineitem"), table(spark, d, "events"), table(spark, d, "embeddings")
    pairs = lines.select(F.concat(F.lit("t"), (F.col("l_linenumber") % 3).cast("string")).alias("term"), F.col("l_quantity").alias("lp_good"), (F.col("l_linenumber") * 7.0).alias("lp_bad"))
    items = lines.select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") % 2).alias("filler"), (F.col("l_linestatus") == "O").cast("int").alias("gap"), F.expr(_Y).alias("y"))
    scalars = events.select(F.col("event_type").alias("run"), F.lit("loss").alias("tag"), F.col("event_id").alias("step"), "value")
    made = {
        "pair_accuracy": pairs,
        "nested_accuracy": pairs.select(F.lit("inner").alias("side"), F.col("term").alias("category"), "lp_good", "lp_bad"),
        "cloze_accuracy": events.groupBy(F.col("user_id").alias("item"), (F.col("user_id") % 3).cast("string").alias("category"), F.col("event_type").alias("cand")).agg((F.count(F.lit(1)) % 2).alias("gold"), F.max("value").alias("logp")),
        "perplexity": lines.select(F.col("l_returnflag").alias("dataset"), (-F.col("l_discount")).alias("logp")),
        "filler_gap_means": items,
        "filler_gap_accuracy": items,
        "last_losses": scalars,
        "distribution": events.select("value"),
        "filler_gap_model": items.drop("gap"),
        "category_mass": None,
    }
    paths = {}
    for name, rows in made.items():
        paths[name] = new_folder(spark, f"results-{name}")
        if rows is not None:
            rows.write.parquet(paths[name])
    return paths


_CELL = "avg(y) FILTER (filler = {f} AND gap = {g})"
_LP = "CASE WHEN l_quantity > l_linenumber * 7 THEN 1.0 ELSE 0 END"
_WIDE = "SELECT item, " + ", ".join(f"{_CELL.format(f=f, g=g)} AS c{f}{g}" for f in (1, 0) for g in (1, 0)) + " FROM i GROUP BY item"
_SQL = f"""WITH i AS (SELECT l_orderkey AS item, l_linenumber % 2 AS filler, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS gap, {_Y} AS y FROM lineitem), m AS (SELECT {", ".join(f"{_CELL.format(f=f, g=g)} AS c{f}{g}" for f in (1, 0) for g in (1, 0))} FROM i),
w AS (SELECT *, (c10 - c00) - (c11 - c01) AS s FROM ({_WIDE}) WHERE c11 + c10 + c01 + c00 IS NOT NULL), a AS (SELECT avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) AS accuracy, avg(s) AS mean_score, stddev_samp(s) AS std_score FROM w),
z AS (SELECT user_id, 'c' AS x, event_type AS cand, count(*) % 2 AS gold, max(value) AS logp FROM events GROUP BY ALL), zb AS (SELECT user_id, arg_max(gold, (logp, cand)) AS ok FROM z GROUP BY user_id),
d AS (SELECT count(*)::DOUBLE AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS least, max(value) AS most FROM events WHERE value IS NOT NULL AND isfinite(value)),
r AS (SELECT 'pair_accuracy' AS evaluator, 't' || (l_linenumber % 3) AS key, avg({_LP}) AS value FROM lineitem GROUP BY 2 UNION ALL SELECT 'pair_accuracy', 'ALL', avg({_LP}) FROM lineitem
UNION ALL SELECT 'nested_accuracy', 'inner/t' || (l_linenumber % 3), avg({_LP}) FROM lineitem GROUP BY 2
UNION ALL SELECT 'cloze_accuracy', CAST(user_id % 3 AS VARCHAR), avg(ok) FROM zb GROUP BY 2
UNION ALL SELECT 'perplexity', l_returnflag, exp(avg(l_discount)) FROM lineitem GROUP BY 2
UNION ALL SELECT 'filler_gap_means', unnest(['wh_gap', 'wh_no_gap', 'no_wh_gap', 'no_wh_no_gap', 'interaction']), unnest([c11, c10, c01, c00, (c10 - c00) - (c11 - c01)]) FROM m
UNION ALL SELECT 'filler_gap_accuracy', unnest(['accuracy', 'mean_score', 'std_score']), unnest([accuracy, mean_score, std_score]) FROM a
UNION ALL SELECT 'last_losses', event_type || '/loss', arg_max(value, event_id) FROM events GROUP BY 2
UNION ALL SELECT 'distribution', unnest(['n', 'mean', 'std', 'least', 'most']), unnest([n, mean, std, least, most]) FROM d
UNION ALL SELECT unnest(['filler_gap_model', 'category_mass', 'unknown']), NULL, NULL)"""


@query(_SQL + " SELECT unnest([200, 400])::BIGINT AS step, evaluator, key, round(value, 5) AS value, key IS NULL AS failed FROM r")
def evaluators_over_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Entries of two steps, in two polls; those that fail have a row without a value, all others their results, and a step outside of the plan none."""
    paths = _tables(spark, d)
    folder, results, checkpoint = new_folder(spark, "catalogue"), new_folder(spark, "results"), new_folder(spark, "checkpoint")
    schema = "step long, evaluator string, path string"
    for step in (200, 300, 400):
        entries = [(step, name, path) for name, path in paths.items()] + [(step, "unknown", "nowhere")]
        spark.createDataFrame(entries, schema).coalesce(1).write.mode("append").parquet(folder)
        if step > 200:
            registry.evaluate_arriving(spark, spark.readStream.schema(schema).parquet(folder), results, checkpoint, steps=[200, 400])
    got = spark.read.schema(registry.RESULTS).parquet(results)
    return got.select("step", "evaluator", "key", F.round("value", 5).alias("value"), F.col("error").isNotNull().alias("failed"))
