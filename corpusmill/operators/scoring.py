"""Token log-probabilities: the table that scorers fill and evaluators read, and count scorers.

The table has run, step, dataset, item_id, cond, cand, tok_pos, token and logp (natural log). A scorer is any
function from a table of (item keys, context, token) to one with logp; here are add-k unigram,
bigram and skip-bigram counts, and a hook for a model that works on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .blocks import valued


def bigrams(texts: DataFrame, stream: str = "pos", words: str = "words") -> DataFrame:
    """stream, tok_pos, prev and token of each word but the first of its text, whose words stand in one array."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(words, F.lit(1), n).alias("prev"), F.slice(words, F.lit(2), n).alias("token"))
    return texts.select(stream, F.posexplode(both).alias("_i", "_p")).select(stream, (F.col("_i") + 1).alias("tok_pos"), "_p.prev", "_p.token")


class CountScorer:
    """log P(token | prev) = log((n(prev, token) + k) / (n(prev) + k V)) from a table of prev and token.

    prev may be any context word: the one before for a bigram, the filler for a skip-bigram. The pair counts are stored once, with their context's.
    """

    def __init__(self, pairs: DataFrame, k: float = 1.0, n: str | None = None, by: str | None = None):
        """n names the column that says how often a pair stands there, if equal pairs are counted already.

        With by, equal pairs are counted for each of its values, and pairs keep these counts in _by, a list of at most as many entries as by has values.
        """
        self.k = k
        times = F.count(F.lit(1)) if n is None else F.sum(n)
        if by is None:
            counts = pairs.groupBy("prev", "token").agg(times.alias("n_pair"))
        else:
            apart = pairs.groupBy("prev", "token", by).agg(times.alias("_n"))
            counts = apart.groupBy("prev", "token").agg(F.sum("_n").alias("n_pair"), F.collect_list(F.struct(by, F.col("_n").alias("n"))).alias("_by"))
        self.pairs = stored(counts, "pair-counts")
        self.prevs = self.pairs.groupBy("prev").agg(F.sum("n_pair").alias("n_prev"))
        self.size = self.pairs.agg(F.greatest(F.count_distinct("token"), F.lit(1)).alias("n_vocab"))

    def _scored(self, pairs: DataFrame) -> DataFrame:
        known = pairs.join(self.prevs, "prev", "left").join(F.broadcast(self.size))  # one row
        p = (F.coalesce("n_pair", F.lit(0)) + self.k) / (F.coalesce("n_prev", F.lit(0)) + self.k * F.col("n_vocab"))
        return known.select(*pairs.columns, F.ln(p).alias("logp")).drop("n_pair")

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (with prev and token) and logp. Contexts are joined to the different pairs; the rows see one join, on the pair."""
        asked = rows.select("prev", "token").distinct().join(self.pairs, ["prev", "token"], "left")
        return rows.join(self._scored(asked), ["prev", "token"])

    def seen(self) -> DataFrame:
        """prev, token, n_pair, n_prev and n_vocab of each counted pair, and what else its row has: all that its probability under any k is made of. One join, on the context."""
        return self.pairs.join(self.prevs, "prev").join(F.broadcast(self.size))  # one row

    def score_seen(self, rows: DataFrame) -> DataFrame:
        """score() of rows whose pairs were all counted, like those that the scorer was made from; others are left out."""
        return rows.join(self._scored(self.pairs), ["prev", "token"])


def pair_logp(k: float) -> Column:
    """logp of a row of CountScorer.seen() under add-k."""
    return F.ln((F.col("n_pair") + k) / (F.col("n_prev") + k * F.col("n_vocab")))


def word_counts(texts: DataFrame, words: str = "words") -> DataFrame:
    """word, n, n_prev and n_token, stored: how often each word stands in the texts, before another word and after one. All in one pass."""
    rows = texts.select(F.size(words).alias("_size"), F.posexplode(words).alias("_i", "word"))
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_i") < F.col("_size") - 1).alias("n_prev"), F.count_if(F.col("_i") > 0).alias("n_token"))
    return stored(counts, "word-counts")


class AskedScorer(CountScorer):
    """CountScorer of the bigrams of texts for the pairs that a condition on prev and token holds for: only these are counted as pairs, contexts and vocabulary come from the words' counts.

    Scores, pairs and score_seen() are those of a CountScorer of all bigrams; score() of a pair that the condition doesn't hold for is an error.
    """

    def __init__(self, texts: DataFrame, asked: Column, k: float = 1.0, words: str = "words", counts: DataFrame | None = None):
        counts = word_counts(texts, words) if counts is None else counts
        self.k, self.asked = k, asked
        self.rows = bigrams(texts, texts.columns[0], words).where(asked)
        self.pairs = stored(self.rows.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n_pair")), "pair-counts")
        self.prevs = counts.where("n_prev > 0").select(F.col("word").alias("prev"), "n_prev")
        self.size = counts.agg(F.greatest(F.count_if(F.col("n_token") > 0), F.lit(1)).alias("n_vocab"))

    def score(self, rows: DataFrame) -> DataFrame:
        known = F.when(F.col("prev").isNull() | F.col("token").isNull() | self.asked, F.col("token")).otherwise(F.raise_error(F.lit("a pair that wasn't counted is asked for")))
        return super().score(rows.withColumn("token", known))


def text_logps(texts: DataFrame, k: float = 1.0, words: str = "words") -> DataFrame:
    """texts' first column and logps: log P(word | word before) of each of its words but the first, in order, as CountScorer has it with add-k.

    Every pair and its context are counted where their blocks' different items meet, and a text's values come back together: no row for each word is shuffled.
    Texts of fewer than two words are left out; the words hold no white space.
    """
    n_vocab = texts.select(F.explode(F.array_distinct(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))))).alias("token")).distinct().count()

    def items(text: str) -> list[str]:
        ws = text.split(" ")
        return [f"{a} {b}" for a, b in zip(ws, ws[1:])] + ws[:-1]

    def value(times: np.ndarray) -> np.ndarray:
        n = len(times) // 2
        return np.log((times[:n] + k) / (times[n:] + k * n_vocab))

    key = texts.columns[0]
    joined = texts.where(F.size(words) > 1).select(key, F.array_join(words, " ").alias("text"))
    return valued(joined, items, value).withColumnRenamed("values", "logps")


def total(logps: Column | str) -> Column:
    """The sum of an array of log-probabilities."""
    return F.aggregate(logps, F.lit(0.0), lambda a, x: a + x)


def chain_probabilities(logps: Column | str, size: int) -> Column:
    """The products of the probabilities of each run of size words of an array."""
    starts = F.sequence(F.lit(1), F.size(logps), F.lit(size))
    return F.transform(starts, lambda i: F.exp(total(F.slice(logps, i, F.lit(size)))))


class UnigramScorer:
    """log P(token) = log((n(token) + k) / (N + k (V + 1))); the one more is for tokens never seen."""

    def __init__(self, tokens: DataFrame, k: float = 1.0):
        self.k = k
        self.counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        self.total = self.counts.agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("n_vocab"))

    def score(self, rows: DataFrame) -> DataFrame:
        known = rows.join(self.counts, "token", "left").join(F.broadcast(self.total))
        p = (F.coalesce("n", F.lit(0)) + self.k) / (F.col("n_all") + self.k * (F.col("n_vocab") + 1))
        return known.withColumn("logp", F.ln(p)).drop("n", "n_all", "n_vocab")


def table_score(rows: DataFrame, logprobs: DataFrame, keys: list[str]) -> DataFrame:
    """rows with logp looked up in a table of log-probabilities, null where it is missing."""
    return rows.join(logprobs.select(*keys, "logp"), keys, "left")


def model_score(rows: DataFrame, model: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """rows with logp from a model that takes a batch of rows."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(logp=model(f).astype("float64"))

    return rows.mapInPandas(score, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", logp double")


def bits(nats: Column) -> Column:
    return nats / F.ln(F.lit(2.0))


def sentence_logprob(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of logp from token 1 on, and the number of tokens."""
    return scored.where("tok_pos >= 1").groupBy(*keys).agg(F.sum("logp").alias("logprob"), F.count(F.lit(1)).alias("n_tokens"))


def perplexity() -> Column:
    """Aggregate: exp of the mean negative log-probability over tokens, not over sentences."""
    return F.exp(-F.sum("logp") / F.count("logp"))


def geometric_mean() -> Column:
    """Aggregate: geometric mean of the probabilities, 0 without any."""
    return F.coalesce(F.exp(F.avg("logp")), F.lit(0.0))


def chain_probability() -> Column:
    """Aggregate: product of the probabilities, 1 without any."""
    return F.coalesce(F.exp(F.sum("logp")), F.lit(1.0))


def lexical_mass(scored: DataFrame, keys: list[str], word: str = "cand") -> DataFrame:
    """Sum over words of the mean probability of their tokens."""
    each = scored.groupBy(*keys, word).agg(F.avg(F.exp("logp")).alias("p"))
    return each.groupBy(*keys).agg(F.sum("p").alias("mass"))


def category_mass(scored: DataFrame, members: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """Sum of the probabilities of the tokens in members (token, category)."""
    return scored.join(members, token).groupBy(*keys, "category").agg(F.sum(F.exp("logp")).alias("mass"))


def mean_of_means(scored: DataFrame, item: str = "item_id", cand: str = "cand") -> DataFrame:
    """Corpus mean of the items' means over candidates of the geometric mean probability, with the number of items."""
    per_cand = scored.groupBy(item, cand).agg(geometric_mean().alias("p"))
    per_item = per_cand.groupBy(item).agg(F.avg("p").alias("p"))
    return per_item.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.avg("p"), F.lit(0.0)).alias("mean_mass"))


def odds(base: str = "base", source: str = "source") -> tuple[Column, Column]:
    """Aggregates over rows of cond (base or int) and cand (base or source answer): the odds shift and the change of the source answer's logp."""
    at = lambda cond, cand: F.max(F.when((F.col("cond") == cond) & (F.col("cand") == cand), F.col("logp")))
    shift = (at("base", base) - at("base", source)) + (at("int", source) - at("int", base))
    return shift, at("int", source) - at("base", source)
