"""Evaluators: pairs, cloze, paired tests, roll-ups, run summaries, anchors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..functions.text import number_after
from ..sources.tables import stored
from . import scoring
from .order import numbered, quantiles, quantiles_of_counts
from .tokens import word_spans


def pair_accuracy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n_pairs, n_correct and accuracy by keys; a pair is right if lp_good > lp_bad, so a tie is wrong. Pairs that lack a side don't count."""
    rows = pairs.dropna(subset=["lp_good", "lp_bad"])
    n, right = F.count(F.lit(1)), F.count_if(F.col("lp_good") > F.col("lp_bad"))
    return rows.groupBy(*keys).agg(n.alias("n_pairs"), right.alias("n_correct"), (right / n).alias("accuracy"))


def micro_accuracy(counts: DataFrame, by: str) -> DataFrame:
    """Sums of n_pairs and n_correct by a column and over all ('ALL'), and their quotient."""
    got = counts.rollup(by).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_correct").alias("n_correct"), F.grouping(by).alias("_all"))
    return got.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by)).alias(by), "n_pairs", "n_correct", (F.col("n_correct") / F.col("n_pairs")).alias("accuracy"))


def arg_max_key(scores: Column | str) -> Column:
    """The key of a map's largest value, the first of equal ones."""
    values = F.map_values(scores)
    return F.try_element_at(F.map_keys(scores), F.array_position(values, F.array_max(values)).cast("int"))


def gold_keys(scores: Column | str) -> Column:
    """The keys of a map whose value is 1."""
    return F.map_keys(F.map_filter(scores, lambda _, v: v == 1))


def paired_t(pairs: DataFrame, width: int, left: str = "src", right: str = "orc") -> DataFrame:
    """A paired t statistic of each dimension of two arrays: flat_idx, layer, dim, n, mean_delta, t_stat, cohens_d."""
    zipped = F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))
    rows = pairs.select(F.posexplode(zipped).alias("flat_idx", "z"))
    delta = F.col("z.r").cast("double") - F.col("z.l").cast("double")
    got = rows.groupBy("flat_idx").agg(F.count(F.lit(1)).alias("n"), F.avg(delta).alias("mean_delta"), F.stddev_samp(delta).alias("_sd"))
    return got.select(
        "flat_idx", F.floor(F.col("flat_idx") / width).alias("layer"), (F.col("flat_idx") % width).alias("dim"), "n", "mean_delta",
        (F.col("mean_delta") / (F.col("_sd") / F.sqrt(F.col("n").cast("double")))).alias("t_stat"), (F.col("mean_delta") / F.col("_sd")).alias("cohens_d"),
    )


def with_p_values(tests: DataFrame) -> DataFrame:
    """tests with p_value and p_value_bonf, times the number of tests and 1 at most."""
    size = tests.agg(F.count(F.lit(1)).alias("_m"))
    p = tests.withColumn("p_value", stats.t_p_value("t_stat", (F.col("n") - 1).cast("double"))).join(F.broadcast(size))
    return p.withColumn("p_value_bonf", F.least(F.col("p_value") * F.col("_m"), F.lit(1.0))).drop("_m")


def top_percent(rows: DataFrame, by: str, percent: float, tie: str) -> DataFrame:
    """The max(1, ceil(percent / 100 * n)) rows of largest by."""
    ranked = numbered(rows.withColumn("_down", -F.col(by)), "_down", "_rank", (tie,), total="_rows")
    return ranked.where(F.col("_rank") < F.greatest(F.lit(1), F.ceil(F.col("_rows") * F.lit(percent) / 100))).drop("_down", "_rank", "_rows")


def rollup_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and median by the columns, with 'ALL' rows for each prefix of them. Medians are found by rank."""
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    levels = F.array(*(F.struct(*(F.col(c).cast("string").alias(c) if i < k else F.lit("ALL").alias(c) for i, c in enumerate(by)), F.lit(k).alias("_level")) for k in range(len(by) + 1)))
    each = counts.select(F.explode(levels).alias("_g"), "_v", "_n").groupBy("_g", "_v").agg(F.sum("_n").alias("_n"))
    each = stored(each.withColumn("_group", F.to_json("_g", {"ignoreNullFields": "false"})), "rollup")
    n = F.sum("_n")
    some = F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))
    got = each.groupBy("_group").agg(F.first("_g").alias("_g"), n.alias("n"), (F.sum(F.col("_v") * F.col("_n")) / some).alias("mean"))
    middle = quantiles_of_counts(each.where("_v is not null").select("_group", "_v", "_n"), {"median": 0.5}, "_group")
    return got.join(middle, "_group", "left").select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", "mean", "median")


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """One row of statistics of the finite values, percentiles interpolated and found by rank, and the mean of their logarithm."""
    v = F.col(value)
    some = stored(rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(v.cast("double").alias("_v"), F.lit(0).alias("_one")), "distribution")
    got = some.agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.avg(F.ln("_v")).alias("cross_entropy"))
    cut = quantiles(some, "_v", {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}, "_one")
    both = got.withColumn("_one", F.lit(0)).join(cut, "_one", "left")  # a row each
    return both.select("n", "mean", "median", "std", "least", "most", "p25", "p75", "p95", "cross_entropy")


def last_values(scalars: DataFrame) -> DataFrame:
    """The last value of each run and tag, and its step."""
    return scalars.groupBy("run", "tag").agg(F.max_by("value", "step").alias("last"), F.max("step").alias("step"))


def tail_mean(scalars: DataFrame, part: int = 10) -> DataFrame:
    """Mean of the last n // part values (one at least) of each run and tag."""
    w = Window.partitionBy("run", "tag")
    rows = scalars.withColumn("_k", F.row_number().over(w.orderBy(F.desc("step")))).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.where(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") / part))).groupBy("run", "tag").agg(F.avg("value").alias("tail_mean"))


def early_stop(scalars: DataFrame, patience: int) -> DataFrame:
    """The step at which the value has not improved (fallen) for patience steps, null if never, and the best value."""
    w = Window.partitionBy("run", "tag").orderBy("step")
    rows = scalars.withColumn("_k", F.row_number().over(w) - 1).withColumn("_best", F.min("value").over(w))
    before = F.lag("_best").over(w)
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("value") < before), F.col("_k")))
    rows = rows.withColumn("_at", F.max("_new").over(w))
    return rows.groupBy("run", "tag").agg(F.min(F.when(F.col("_k") - F.col("_at") >= patience, F.col("step"))).alias("stop_step"), F.min("_best").alias("best"))


def wide(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """base left joined with each part by key; what a part lacks is null."""
    for part in parts.values():
        base = base.join(part, key, "left")
    return base


def summary(metrics: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each key with a column for each field from metrics (key, name, value); null where a metric is missing, the last of repeated ones counts."""
    return metrics.where(F.col("name").isin(*fields)).groupBy(key).agg(*(F.max(F.when(F.col("name") == f, F.col("value"))).alias(f) for f in fields))


def collected(configs: DataFrame, scalars: DataFrame, tags: dict[str, str]) -> DataFrame:
    """configs (run and its settings) with the last value of each tag of the run's scalars under the tag's name; null where it has none."""
    last = last_values(scalars.where(F.col("tag").isin(*tags)))
    wide_ = last.groupBy("run").agg(*(F.max(F.when(F.col("tag") == t, F.col("last"))).alias(n) for t, n in tags.items()))
    return configs.join(wide_, "run", "left")


def best_by(rows: DataFrame, keys: list[str], by: str, order: list[str]) -> DataFrame:
    """Of each group the row of largest by, the first in order of equal ones."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), *order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def hyper_parameters(name: Column) -> list[Column]:
    """lr, wd, warm and bs from a run's name, with points or p for decimals; null where the name lacks them."""
    plain = lambda pattern: F.replace(F.regexp_extract(name, pattern, 1), F.lit("p"), F.lit(".")).try_cast("double")
    return [
        number_after(name, "lr([0-9.]+(?:e-?[0-9]+)?)").alias("lr"), plain("wd([0-9]+[.p]?[0-9]*)").alias("wd"),
        plain("(?:warm|wu)([0-9]+[.p]?[0-9]*)").alias("warm"), number_after(name, "bs([0-9]+)").alias("bs"),
    ]


def sweep(items: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of odds and delta by keys."""
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("odds").alias("odds_mean"), F.stddev_pop("odds").alias("odds_std"), F.avg("delta").alias("delta_mean"), F.stddev_pop("delta").alias("delta_std")
    )


def best_row(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The row of largest by, the first in order of equal ones."""
    return rows.orderBy(F.desc_nulls_last(by), *order).limit(1)


def char_spans(docs: DataFrame, key: str) -> DataFrame:
    """key, token_no, start, end of each word as if single spaces parted them."""
    return word_spans(docs, key=key).select(key, F.col("word_no").alias("token_no"), "start", "end")


def overlaps(anchors: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """For each anchor span the first token that overlaps it and how many do."""
    hit = (anchors[key] == tokens[key]) & (tokens["start"] < anchors["a_end"]) & (tokens["end"] > anchors["a_start"])
    return anchors.join(tokens, hit).groupBy(anchors[key]).agg(F.min("token_no").alias("token_no"), F.count(F.lit(1)).alias("n_tokens"))


def token_of_anchor(anchors: DataFrame, tokens: DataFrame, key: str, occurrence: str = "occurrence") -> DataFrame:
    """The first overlapping token of an anchor's only occurrence; null where it doesn't occur, an error where several differ."""
    first = overlaps(anchors, tokens, key).select(key, "token_no")
    per = first.groupBy(key).agg(F.count_distinct("token_no").alias("_n"), F.min("token_no").alias("token_no"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("the anchor is ambiguous"))).otherwise(F.col("token_no"))
    return per.select(key, checked.cast("int").alias("token_no"))


def last_words(rows: DataFrame, labels: list[str]) -> DataFrame:
    """The last words of each row, labelled from left to right; rows with fewer words than labels are left out."""
    n = len(labels)
    some = rows.where(F.size("words") >= n)
    pairs = F.arrays_zip(F.array(*map(F.lit, labels)).alias("position_label"), F.slice("words", -n, n).alias("anchor"))
    return some.select("*", F.inline(pairs))


def length_status(n: Column, least: int, most: int) -> Column:
    return F.when(n < least, "short").when(n > most, "long").otherwise("ok")


def evaluation_steps(spark, every: int, last: int) -> DataFrame:
    """The multiples of every up to last, and last."""
    steps = F.array_union(F.sequence(F.lit(every), F.lit(last), F.lit(every)), F.array(F.lit(last))) if last >= every else F.array(F.lit(last))
    return spark.range(1).select(F.explode(steps).alias("step"))


def latest(paths: DataFrame, by: list[str], path: str = "path", step: str = "step") -> DataFrame:
    """The path of the largest step of each group."""
    return paths.groupBy(*by).agg(F.max_by(path, step).alias(path), F.max(step).alias(step))


def cloze_best(examples: DataFrame, scored: DataFrame) -> DataFrame:
    """item, category, lost (candidates without a score) and ok: 1 if the best candidate, the first of equal ones, is a gold one.

    examples has item, category and target_scores; scored has item, cand and logp.
    """
    cands = examples.select("item", "category", gold_keys("target_scores").alias("gold"), F.posexplode(F.map_keys("target_scores")).alias("at", "cand"))
    rows = cands.join(scored.select("item", "cand", "logp"), ["item", "cand"], "left")
    best = rows.groupBy("item", "category").agg(F.count_if(F.col("logp").isNull()).alias("lost"), F.max_by(F.struct("cand", "gold"), F.struct("logp", -F.col("at"))).alias("b"))
    return best.select("item", "category", "lost", F.array_contains("b.gold", F.col("b.cand")).cast("int").alias("ok"))


def cloze_accuracy(examples: DataFrame, scored: DataFrame) -> DataFrame:
    """n, n_correct and accuracy by category and over all ('ALL') of cloze_best(); examples that lack a score don't count."""
    right = cloze_best(examples, scored).where("lost = 0")
    got = right.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("n_correct"), F.grouping("category").alias("_all"))
    return got.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category")).alias("category"), "n", "n_correct", (F.col("n_correct") / F.col("n")).alias("accuracy"))


def candidate_masses(contexts: DataFrame, candidates: DataFrame, scorer: scoring.CountScorer) -> DataFrame:
    """slot, n_items and mean_mass: the mean over contexts of the mean over a slot's candidates of their geometric mean probability.

    contexts has item_id and text, candidates slot and cand. A candidate's first word is scored after the context's
    last one, the others after the one before. So candidates are paired with the different last words only, and contexts that share one are counted.
    """
    lasts = stored(contexts.select(T.last_word("text").alias("last")).groupBy("last").agg(F.count(F.lit(1)).alias("n")), "last-words")
    listed = candidates.agg(F.collect_list(F.struct("slot", "cand", T.words("cand").alias("ws"))).alias("_c"))  # one row: the candidates are a fixed list
    rows = lasts.select("last").crossJoin(F.broadcast(listed)).select("last", F.inline("_c"))
    rows = rows.select("slot", "cand", "last", "ws", F.posexplode("ws").alias("tok_pos", "token"))
    rows = rows.withColumn("prev", F.when(F.col("tok_pos") == 0, F.col("last")).otherwise(F.try_element_at("ws", F.col("tok_pos"))))
    per_cand = scorer.score(rows).groupBy("slot", "last", "cand").agg(scoring.geometric_mean().alias("p"))
    per_last = per_cand.groupBy("slot", "last").agg(F.avg("p").alias("p")).join(lasts, "last")
    return per_last.groupBy("slot").agg(F.sum("n").alias("n_items"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mean_mass"))


#: Evaluators by name: functions of a table of scores and keys that give keys and value.
EVALUATORS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "pair_accuracy": lambda rows, keys: pair_accuracy(rows, keys).withColumnRenamed("accuracy", "value"),
    "perplexity": lambda rows, keys: rows.groupBy(*keys).agg(scoring.perplexity().alias("value")),
    "geometric_mean": lambda rows, keys: rows.groupBy(*keys).agg(scoring.geometric_mean().alias("value")),
}


def run(name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """evaluator, keys and value of an evaluator called by name; an unknown name is an error."""
    if name not in EVALUATORS:
        raise ValueError(f"no evaluator {name}; there are {', '.join(sorted(EVALUATORS))}")
    return EVALUATORS[name](rows, keys).select(F.lit(name).alias("evaluator"), *keys, "value")
