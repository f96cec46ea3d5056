"""Sentence corpora: lines with explicit order, first occurrences, hold-outs, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .order import numbered

def pair(high: Column | str, low: Column | str) -> Column:
    """Two numbers as one decimal that orders as they do: high * 2^32 + low, for low of under 2^32."""
    high, low = (F.col(c) if isinstance(c, str) else c for c in (high, low))
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(10,0)")).cast("decimal(38,0)")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos and text of each line; pos is the order over the whole table, doc_id and line as one decimal (a text has under 2^32 lines)."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("_line", "text"))
    return split.select("doc_id", pair("doc_id", "_line").alias("pos"), "text")


def nonempty(corpus: DataFrame, keep_spaces: bool = False) -> DataFrame:
    """The lines that aren't blank, stripped unless keep_spaces."""
    bare = T.strip("text")
    return corpus.where(bare != "") if keep_spaces else corpus.withColumn("text", bare).where("text <> ''")


def first_occurrences(corpus: DataFrame, *key: str) -> DataFrame:
    """One row for each different text (or other key), with the first position and the number of copies."""
    return corpus.groupBy(*(key or ("text",))).agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies"))


def hold_out(candidates: DataFrame, train: DataFrame, exact: bool = False) -> DataFrame:
    """First occurrences of candidates whose text isn't in train.

    Texts are compared stripped and without the end mark, as training lines may carry it; exact compares them as they are.
    """
    key: Column = T.strip(F.replace(F.col("text"), F.lit(T.END), F.lit("")))
    if exact:
        left = candidates.join(train.select("text").distinct(), "text", "left_anti")
        return left.groupBy("text").agg(F.min("pos").alias("pos"))
    mine = candidates.withColumn("_key", key)
    theirs = train.select(key.alias("_key")).distinct()
    left = mine.join(theirs, "_key", "left_anti")
    return left.groupBy("_key").agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos")).drop("_key")


def words_of(corpus: DataFrame) -> DataFrame:
    """pos, word_no (from 0) and word of each white-space word."""
    return corpus.select("pos", F.posexplode(T.words("text")).alias("word_no", "word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, idx by first occurrence and freq, from words with pos and word_no (under 2^31).

    Both make one decimal, so that the smallest is found by a hash aggregate.
    """
    at = (F.col("pos").cast("decimal(28,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("word_no").cast("decimal(10,0)")).cast("decimal(38,0)")
    seen = words.groupBy("word").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("freq"))
    return numbered(seen, "at", "idx", settled=True).select("word", "idx", "freq")


def encoded(words: DataFrame, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """words with idx, unknown where the vocabulary lacks the word."""
    return words.join(vocab.select("word", "idx"), "word", "left").withColumn("idx", F.coalesce("idx", F.lit(unknown)))


def coverage(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: different words, those in the vocabulary, and those missing."""
    seen = words.select("word").distinct().join(vocab.select("word", F.lit(1).alias("_in")), "word", "left")
    return seen.agg(F.count(F.lit(1)).alias("n_words"), F.count("_in").alias("ok"), F.count_if(F.col("_in").isNull()).alias("bad"))


def missing(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word and n of the words that the vocabulary (word) lacks: the list behind coverage()'s count."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocab.select("word").distinct(), "word", "left_anti")


def structure_frequency(corpus: DataFrame, marked: Column) -> Column:
    """Aggregate: percentage of rows that are marked, 0 without rows."""
    return F.coalesce(100 * F.avg(marked.cast("double")), F.lit(0.0))


def all_known(rows: DataFrame, key: str, words: str, vocab: DataFrame) -> DataFrame:
    """The rows all of whose words (an array) the vocabulary holds; rows without words pass."""
    seen = rows.select(key, F.explode(words).alias("word"))
    bad = seen.join(vocab.select("word").distinct(), "word", "left_anti").select(key).distinct()
    return rows.join(bad, key, "left_anti")


def lexicons(vocab: DataFrame) -> DataFrame:
    """word and kind (noun, verb) of a vocabulary by endings and verb seeds.

    Without any noun, all words that are no verbs by seed or ending are nouns. An error if either kind stays empty.
    """
    ws = vocab.select(T.lower("word").alias("word")).distinct()
    seed, ended = F.col("word").isin(*T.VERB_SEEDS), T.ends_like("word", T.VERB_ENDINGS)
    nouns, verbs = ws.where(T.ends_like("word", T.NOUN_ENDINGS)), ws.where(seed | ended)
    if nouns.isEmpty():
        nouns = ws.where(~seed & ~ended)
    if nouns.isEmpty() or verbs.isEmpty():
        raise ValueError("the vocabulary gives no nouns or no verbs")
    return nouns.withColumn("kind", F.lit("noun")).unionByName(verbs.withColumn("kind", F.lit("verb")))
