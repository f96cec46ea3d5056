"""Evaluators of probability masses at a gap site: noun phrases, nouns and verbs, against comparators.

A scorer gives log P(token | previous word). A phrase's mass after a context is the geometric mean of its words' probabilities, the first
word's after the context's last one. Word lists are short and fixed, so they are exploded beside each different
context word, not joined to every sentence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored
from . import scoring
from .evaluate import rollup_summary
from .generate import options
from .order import quantiles_of_counts


def phrase_masses(rows: DataFrame, scorer: scoring.CountScorer) -> DataFrame:
    """The different (last, phrase) of rows with mass, the geometric mean of the phrase's words after last."""
    each = rows.select("last", "phrase").distinct().select("last", "phrase", F.posexplode(F.concat(F.array("last"), T.words("phrase"))).alias("_i", "_w"), T.words("phrase").alias("_ws"))
    pairs = each.where(F.col("_i") < F.size("_ws")).select("last", "phrase", F.col("_w").alias("prev"), F.try_element_at("_ws", F.col("_i") + 1).alias("token"))
    return scorer.score(pairs).groupBy("last", "phrase").agg(scoring.geometric_mean().alias("mass"))


def sites(sentences: DataFrame, verbs: Sequence[str], column: str = "sentence") -> DataFrame:
    """sentences with last, the first of its words that is one of the verbs (normalised); sentences without one are left out."""
    ws = F.transform(T.words(column), T.normalize_word)
    return sentences.withColumn("last", F.try_element_at(F.filter(ws, lambda w: w.isin(*verbs)), F.lit(1))).where("last is not null")


def _means(rows: DataFrame, columns: dict[str, str], name: str) -> DataFrame:
    """One row: mean of each column under its new name, median under it with _median, nulls left out; a row stands for n alike, name is of one group."""
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
    out = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("roi_count"), *(mean(c).alias(n) for c, n in columns.items())).withColumn("_one", F.lit(0))
    for c, n in columns.items():
        counts = rows.where(F.col(c).isNotNull()).groupBy(F.lit(0).alias("_one"), F.col(c).cast("double").alias("_v")).agg(F.sum("n").alias("_n"))
        cut = quantiles_of_counts(counts, {f"{n}_median": 0.5}, "_one")
        out = out.join(cut, "_one", "left")
    return out.withColumn("structure", F.lit(name)).drop("_one")


def moved_embedded_vocabulary(sentences: DataFrame, verbs: Sequence[str], nouns: Sequence[str], vocabulary: Sequence[str], scorer: scoring.CountScorer) -> DataFrame:
    """One row: mean and median mass of the moved noun phrase, the embedded one, and the vocabulary's phrases without both heads, and their differences.

    Sentences without a verb or a moved phrase, or with no vocabulary left, don't count; one without an embedded phrase counts for the others.
    """
    ws = T.words("sentence")
    rows = sites(sentences, verbs).select("sentence", "last", T.lower(T.moved_np(ws, nouns)).alias("moved"), T.lower(T.embedded_np(ws, nouns)).alias("embedded")).where("moved is not null")
    rows = rows.groupBy("last", "moved", "embedded").agg(F.count(F.lit(1)).alias("n"))  # equal cases are worked out once
    rows = stored(rows.withColumns({"moved_head": T.last_word("moved"), "embedded_head": T.last_word("embedded")}), "np-cases")
    noun = F.explode(options(list(vocabulary))).alias("noun")
    listed = rows.select("last").distinct().select("last", noun).withColumn("phrase", F.concat(F.lit("the "), "noun"))
    asked = rows.select("last", F.explode(F.array_compact(F.array("moved", "embedded"))).alias("phrase"))
    masses = stored(phrase_masses(asked.unionByName(listed.select("last", "phrase")), scorer), "np-masses")
    of = lambda c, name: masses.select("last", F.col("phrase").alias(c), F.col("mass").alias(name))
    every = listed.join(masses, ["last", "phrase"]).groupBy("last").agg(F.map_from_entries(F.collect_list(F.struct("noun", "mass"))).alias("_all"))  # a word list
    full = rows.join(of("moved", "target"), ["last", "moved"]).join(of("embedded", "embedded_mass"), ["last", "embedded"], "left").join(every, "last")
    left = F.map_values(F.map_filter("_all", lambda k, _: (k != F.col("moved_head")) & ~F.coalesce(k == F.col("embedded_head"), F.lit(False))))
    full = full.withColumn("vocab", F.when(F.size(left) > 0, F.aggregate(left, F.lit(0.0), lambda a, x: a + x) / F.size(left))).where("vocab is not null")
    got = _means(stored(full.select("target", "embedded_mass", "vocab", "n"), "np-rows"), {"target": "target_mass", "embedded_mass": "embedded_mass", "vocab": "vocab_mass"}, "orc")
    return got.withColumns(
        {"target_minus_vocab": F.col("target_mass") - F.col("vocab_mass"), "target_minus_embedded": F.col("target_mass") - F.col("embedded_mass"), "embedded_minus_vocab": F.col("embedded_mass") - F.col("vocab_mass")}
    )


def target_and_comparator(contexts: DataFrame, comparators: Sequence[str], scorer: scoring.CountScorer, structure: str, targets: Sequence[str] = ()) -> DataFrame:
    """One row: mean and median mass of a target phrase and of its head, of "the", and of the comparators, and the difference of target and comparator.

    contexts has last and, if targets is empty, phrase, the target of each row. With targets, the target is the mean over all of them; the
    comparator is always the mean over its list.
    """
    if targets:
        contexts = contexts.withColumn("phrase", F.lit(None).cast("string"))
    rows = stored(contexts.groupBy("last", "phrase").agg(F.count(F.lit(1)).alias("n")), "target-cases")
    fixed = [*comparators, *targets, *(t.split()[-1] for t in targets), "the"]
    asked = rows.select("last").distinct().select("last", F.explode(options(list(dict.fromkeys(fixed)))).alias("phrase"))
    heads = rows.where("phrase is not null").select("last", F.explode(F.array("phrase", T.last_word("phrase"))).alias("phrase"))
    masses = stored(phrase_masses(asked.unionByName(heads), scorer), "target-masses")
    table = masses.groupBy("last").agg(F.map_from_entries(F.collect_list(F.struct("phrase", "mass"))).alias("_m"))  # fixed lists and the cases' phrases
    mean = lambda words: sum((F.element_at("_m", F.lit(w)) for w in words), F.lit(0.0)) / len(words)
    own = lambda c: F.element_at(F.col("_m"), c)
    target, head = (mean(targets), mean([t.split()[-1] for t in targets])) if targets else (own(F.col("phrase")), own(T.last_word("phrase")))
    each = rows.join(table, "last").select(target.alias("t"), head.alias("h"), own(F.lit("the")).alias("the"), mean(comparators).alias("c"), "n")
    got = _means(stored(each, "target-rows"), {"t": "target_mass", "h": "target_head_mass", "the": "the_mass", "c": "comparator_mass"}, structure)
    return got.drop("the_mass_median").withColumn("target_minus_comparator", F.col("target_mass") - F.col("comparator_mass"))


def transitivity_masses(rows: DataFrame, scorer: scoring.CountScorer) -> DataFrame:
    """Mass of the moved noun after the verb: n, mean and median by verb type and verb, with 'ALL' rows, and on the last one the difference of the types.

    rows has pre_gap_text, moved_np, verb and verb_type; rows without context don't count.
    """
    some = rows.where(F.size(T.words("pre_gap_text")) > 0).select("verb_type", "verb", T.last_word("pre_gap_text").alias("last"), T.last_word("moved_np").alias("phrase"))
    some = stored(some, "transitivity-cases")
    scored = some.join(phrase_masses(some, scorer), ["last", "phrase"])
    got = stored(rollup_summary(scored, ["verb_type", "verb"], "mass"), "transitivity-masses")
    types = got.where("verb = 'ALL'").agg((F.max(F.when(F.col("verb_type") == "transitive", F.col("mean"))) - F.max(F.when(F.col("verb_type") == "intransitive", F.col("mean")))).alias("difference"))
    whole = (F.col("verb_type") == "ALL") & (F.col("verb") == "ALL")
    return got.crossJoin(F.broadcast(types)).withColumn("difference", F.when(whole, F.col("difference")))  # one row


def verb_sites(pairs: DataFrame, lexicon: DataFrame, scorer: scoring.CountScorer) -> DataFrame:
    """One row: over the words in pairs (token, target and, if equal ones are counted already, n) that are verbs of the lexicon (word, kind), how many, and the mean mass of nouns and of verbs after them, their difference, and the mean probability of the word that follows.

    The masses after a word are sums over the lexicon of pair counts, worked out once for each different word.
    """
    verbs = lexicon.where("kind = 'verb'").select(F.col("word").alias("_verb"))
    rows = pairs.where("target is not null").join(verbs, T.lower("token") == F.col("_verb")).groupBy(F.col("token").alias("prev"), F.col("target").alias("token")).agg((F.sum("n") if "n" in pairs.columns else F.count(F.lit(1))).alias("n"))
    rows = stored(rows, "verb-sites")
    sizes = lexicon.agg(*(F.count_if(F.col("kind") == k).alias(f"_{k}s") for k in ("noun", "verb")))
    listed = scorer.pairs.join(lexicon, scorer.pairs["token"] == lexicon["word"])
    seen = listed.groupBy("prev").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n_pair"))), F.lit(0)).alias(f"_{k}") for k in ("noun", "verb")))
    per = rows.select("prev").distinct().join(seen, "prev", "left").join(scorer.prevs, "prev", "left").join(F.broadcast(scorer.size)).join(F.broadcast(sizes))  # one row each
    mass = lambda k: (F.coalesce(f"_{k}", F.lit(0)) + scorer.k * F.col(f"_{k}s")) / (F.coalesce("n_prev", F.lit(0)) + scorer.k * F.col("n_vocab"))
    per = per.select("prev", mass("noun").alias("noun_mass"), mass("verb").alias("verb_mass"))
    full = scorer.score(rows).join(per, "prev")
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    got = full.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("roi_count"), mean(F.col("noun_mass")).alias("mean_noun_mass"), mean(F.col("verb_mass")).alias("mean_verb_mass"), mean(F.exp("logp")).alias("mean_next_prob")
    )
    return got.withColumn("mean_noun_minus_verb", F.col("mean_noun_mass") - F.col("mean_verb_mass"))


def masses_by_file(rows: DataFrame, keys: list[str], files: dict[str, str], columns: Sequence[str] = ("np", "vp", "q")) -> DataFrame:
    """For each of keys the means of the columns over the rows of each file, named after it; files gives each name's file."""
    means: list[Column] = [F.avg(F.when(F.col("file") == file, F.col(c))).alias(f"{name}_{c}") for name, file in files.items() for c in columns]
    return rows.groupBy(*keys).agg(*means)
