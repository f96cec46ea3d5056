"""Evaluators by name over a catalogue of runs: which table each step's evaluator reads, and what came out, as rows of one form.

An evaluator takes a table of results and gives key and value. One that fails, because its table isn't there or lacks a column, or holds what can't be
computed with, gives a row without a value and the reason; all others go on. As catalogues come in through a stream, each batch's entries are worked out and put
into the table of results in place of those of the same step and evaluator.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import upsert
from ..sources.tables import stored
from ..streaming import packing
from . import density, evaluate, factorial, mixed, scoring

Evaluator = Callable[[DataFrame], DataFrame]
#: Evaluators by name: functions of a table that give a key (string) and its value.
REGISTRY: dict[str, Evaluator] = {}
RESULTS = "step long, evaluator string, key string, value double, error string"


def evaluator(name: str) -> Callable[[Evaluator], Evaluator]:
    def add(f: Evaluator) -> Evaluator:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = f
        return f

    return add


def _long(wide: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """A row for each column of a few wide rows: its name, behind the row's by, and its value."""
    name = lambda c: F.lit(c) if by is None else F.concat_ws("/", F.col(by).cast("string"), F.lit(c))
    pairs = F.array(*(F.struct(name(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns))
    return wide.select(F.inline(pairs))


@evaluator("pair_accuracy")
def _pair_accuracy(rows: DataFrame) -> DataFrame:
    """Of minimal pairs (term, lp_good, lp_bad) by term and over all."""
    return evaluate.micro_accuracy(evaluate.pair_accuracy(rows, ["term"]), "term").select(F.col("term").alias("key"), F.col("accuracy").alias("value"))


@evaluator("nested_accuracy")
def _nested_accuracy(rows: DataFrame) -> DataFrame:
    """Of pairs of inner and outer dependencies (side, category, lp_good, lp_bad)."""
    return evaluate.pair_accuracy(rows, ["side", "category"]).select(F.concat_ws("/", "side", "category").alias("key"), F.col("accuracy").alias("value"))


@evaluator("cloze_accuracy")
def _cloze_accuracy(rows: DataFrame) -> DataFrame:
    """Of cloze candidates (item, category, cand, gold, logp): the share of items whose best candidate is gold."""
    best = rows.groupBy("item", "category").agg(F.max_by("gold", F.struct("logp", "cand")).cast("double").alias("ok"))
    return best.groupBy("category").agg(F.avg("ok").alias("value")).select(F.col("category").alias("key"), "value")


@evaluator("perplexity")
def _perplexity(rows: DataFrame) -> DataFrame:
    """Of tokens (dataset, logp)."""
    return rows.groupBy("dataset").agg(scoring.perplexity().alias("value")).select(F.col("dataset").alias("key"), "value")


@evaluator("geometric_mean")
def _geometric_mean(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset").agg(scoring.geometric_mean().alias("value")).select(F.col("dataset").alias("key"), "value")


@evaluator("chain_probability")
def _chain_probability(rows: DataFrame) -> DataFrame:
    """The mean over candidates (item, cand, logp) of the product of their tokens' probabilities."""
    return rows.groupBy("item", "cand").agg(scoring.chain_probability().alias("p")).agg(F.lit("mean").alias("key"), F.avg("p").alias("value"))


@evaluator("filler_gap_means")
def _filler_gap_means(rows: DataFrame) -> DataFrame:
    """The cells' means and their interaction (filler, gap, y)."""
    return _long(factorial.cell_means(rows), [*factorial.CELLS, "interaction"])


@evaluator("filler_gap_accuracy")
def _filler_gap_accuracy(rows: DataFrame) -> DataFrame:
    return _long(factorial.accuracy(rows), ["accuracy", "mean_score", "std_score"])


@evaluator("filler_gap_model")
def _filler_gap_model(rows: DataFrame) -> DataFrame:
    """The mixed model of any items (item, filler, gap, y)."""
    return _long(mixed.fitted(rows), ["b_0", "b_filler", "b_gap", "b_interaction", "se_interaction", "licensing", "licensing_low", "licensing_high"])


@evaluator("within_item_interval")
def _within_item_interval(rows: DataFrame) -> DataFrame:
    return _long(factorial.within_item_interval(rows), ["mean", "se", "low", "high"])


@evaluator("candidate_mass")
def _candidate_mass(rows: DataFrame) -> DataFrame:
    """Masses of candidates at a site (slot, item_id, cand, logp): the mean over items of the mean over candidates."""
    per = rows.groupBy("slot", "item_id", "cand").agg(scoring.geometric_mean().alias("p")).groupBy("slot", "item_id").agg(F.avg("p").alias("p"))
    return per.groupBy("slot").agg(F.avg("p").alias("value")).select(F.col("slot").alias("key"), "value")


@evaluator("category_mass")
def _category_mass(rows: DataFrame) -> DataFrame:
    """Mean over sites (item_id, category, logp) of the sum of a category's probabilities."""
    per = rows.groupBy("item_id", "category").agg(F.sum(F.exp("logp")).alias("p"))
    return per.groupBy("category").agg(F.avg("p").alias("value")).select(F.col("category").alias("key"), "value")


@evaluator("transitivity_masses")
def _transitivity_masses(rows: DataFrame) -> DataFrame:
    """Means and medians by the levels of a roll-up (structure, verb_class, mass)."""
    got = evaluate.rollup_summary(rows, ["structure", "verb_class"], "mass")
    return _long(got.withColumn("_k", F.concat_ws("/", "structure", "verb_class")), ["mean", "median"], "_k")


@evaluator("token_profile")
def _token_profile(rows: DataFrame) -> DataFrame:
    """Mean surprisal by condition, length and position (item, cond, tok_pos, token, surprisal)."""
    got = factorial.token_profile(rows)
    return got.select(F.concat_ws("/", "cond", "length", "tok_pos").alias("key"), F.col("mean").alias("value"))


@evaluator("odds_delta")
def _odds_delta(rows: DataFrame) -> DataFrame:
    """Of interventions (layer, odds, delta), by layer."""
    got = evaluate.sweep(rows, ["layer"])
    return _long(got, ["odds_mean", "odds_std", "delta_mean", "delta_std"], "layer")


@evaluator("paired_test")
def _paired_test(rows: DataFrame) -> DataFrame:
    """The t statistic of each dimension of two arrays (src, orc), in one layer."""
    width = rows.select(F.size("src")).first()
    got = evaluate.paired_t(rows, width[0] if width else 1)
    return got.select(F.col("flat_idx").cast("string").alias("key"), F.col("t_stat").alias("value"))


@evaluator("distribution")
def _distribution(rows: DataFrame) -> DataFrame:
    """Of values (value): number, mean, deviation, ends."""
    return _long(evaluate.distribution(rows, "value"), ["n", "mean", "std", "least", "most"])


@evaluator("density_overlap")
def _density_overlap(rows: DataFrame) -> DataFrame:
    """How far the densities of base and other (side, value) lie over each other."""
    return density.overlap(density.gaussian(rows, "value", "side"), "side", [("base", "other")]).select(F.lit("base/other").alias("key"), F.col("overlap").alias("value"))


@evaluator("last_losses")
def _last_losses(rows: DataFrame) -> DataFrame:
    """The last value of each tag of event files (run, tag, step, value)."""
    return evaluate.last_values(rows).select(F.concat_ws("/", "run", "tag").alias("key"), F.col("last").cast("double").alias("value"))


@evaluator("tail_losses")
def _tail_losses(rows: DataFrame) -> DataFrame:
    return evaluate.tail_mean(rows).select(F.concat_ws("/", "run", "tag").alias("key"), F.col("tail_mean").cast("double").alias("value"))


def evaluated(spark: SparkSession, step: int, name: str, path: str) -> DataFrame:
    """The results of one evaluator over one Parquet table, as a stored table; or one row with the reason why there are none."""
    head = [F.lit(step).cast("long").alias("step"), F.lit(name).alias("evaluator")]
    try:
        if name not in REGISTRY:
            raise ValueError(f"no evaluator {name}")
        got = REGISTRY[name](spark.read.parquet(path))
        return stored(got.select(*head, F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("error")), "evaluated")
    except (PySparkException, Py4JJavaError, ValueError) as e:
        said = [line.lstrip(": ") for line in str(e).splitlines() if line.strip() and not line.startswith("An error occurred while calling")]
        reason = said[0][:300] if said else type(e).__name__
        return spark.createDataFrame([(step, name, None, None, reason)], RESULTS)


def evaluated_all(spark: SparkSession, catalogue: list[tuple[int, str, str]]) -> DataFrame:
    """RESULTS of the entries (step, evaluator, path) of a catalogue."""
    return reduce(DataFrame.unionByName, [evaluated(spark, *entry) for entry in catalogue], spark.createDataFrame([], RESULTS))


def evaluate_arriving(spark: SparkSession, catalogue: DataFrame, results: str, checkpoint: str, steps: list[int] | None = None) -> None:
    """Works out the entries (step, evaluator, path) that a stream has brought since the last call, with steps only those of these steps, into the table at results.

    A batch's entries are the jobs it asks for, so their list is on the driver. The table has a folder for each step; results of a step and evaluator that are there already are replaced.
    """

    def handle(batch: DataFrame, _: int) -> None:
        asked = batch if steps is None else batch.where(F.col("step").isin(*steps))
        entries = [tuple(r) for r in asked.select("step", "evaluator", "path").distinct().orderBy("step", "evaluator", "path").collect()]
        if entries:
            upsert(evaluated_all(spark, entries), results, ["step", "evaluator", "key"], "step")

    packing.poll(spark, catalogue, checkpoint, handle)
