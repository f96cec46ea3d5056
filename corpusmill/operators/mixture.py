"""Weighted mixtures of sources, endless sources and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .order import numbered, running_sum
from .sampling import uniform
from .tokens import slices


def normalized(weights: dict[str, float]) -> list[tuple[str, float]]:
    """The sources of weight over 0 with the upper end of their share of 0 to 1."""
    total, at, out = sum(w for w in weights.values() if w > 0), 0.0, []
    if total <= 0:
        raise ValueError("no source has a weight over 0")
    for name, w in weights.items():
        if w > 0:
            at += w / total
            out.append((name, at))
    return out


def drawn(u: Column, weights: dict[str, float]) -> Column:
    """The source in whose share u falls."""
    shares = normalized(weights)
    out = F.lit(shares[-1][0])
    for name, end in reversed(shares[:-1]):
        out = F.when(u < round(end, 12), F.lit(name)).otherwise(out)
    return out


def _draws(df: DataFrame, n: int, name: str, weights: dict[str, float], seed: int | str) -> DataFrame:
    """n numbered draws of a source, and which one of its source each is."""
    rows = df.sparkSession.range(n).select(F.col("id").alias(name))
    rows = rows.withColumn("source", drawn(uniform(name, seed), weights))
    return numbered(rows, name, "_k", by="source", settled=True)


def _places(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """source, pos, _n (words), at and n_stream, the documents' places in their sources' streams of words; and each source's full blocks, _blocks. Only numbers of words are ordered."""
    sized = docs.select("source", "pos", F.size("words").cast("long").alias("_n"))
    at = stored(running_sum(sized, "pos", "_n", "at", by="source", total="n_stream"), "source-streams")
    return at, at.groupBy("source").agg(F.floor(F.max("n_stream") / size).alias("_blocks"))


def _slices(streams: DataFrame, size: int) -> DataFrame:
    return slices(streams.withColumn("pos", F.struct("source", "pos")), size).select("pos.source", F.col("block_id").alias("source_block"), "at", "tokens")


def source_blocks(docs: DataFrame, size: int) -> DataFrame:
    """source, at (the block's number), n (full blocks of the source) and tokens of the blocks that each source's words make in order of pos."""
    at, sizes = _places(docs, size)
    flat, sizes = docs.select("source", "pos", "words").join(at.drop("_n"), ["source", "pos"]), sizes.withColumnRenamed("_blocks", "n")
    whole = _slices(flat, size).groupBy("source", "source_block").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("_s"))  # size tokens
    rows = whole.select("source", F.col("source_block").alias("at"), F.flatten(F.transform("_s", lambda s: s["tokens"])).alias("tokens"))
    return rows.join(F.broadcast(sizes), "source")  # a row for each source


def per_block(docs: DataFrame, weights: dict[str, float], n_blocks: int, size: int, seed: int | str) -> DataFrame:
    """Blocks of size words, each of one source drawn by weight, so that words come in proportion to the weights.

    docs has source, pos and words. A source's words are one stream in order of pos, cut into blocks; a source that
    runs out starts again. Gives block_no, source, source_block, g and token.
    """
    sources = [name for name, _ in normalized(weights)]
    mine = docs.where(F.col("source").isin(sources))
    at, sizes = _places(mine, size)
    draws = _draws(docs, n_blocks, "block_no", weights, seed).join(F.broadcast(sizes), "source")  # a row for each source
    draws = stored(draws.where("_blocks > 0").select("block_no", "source", (F.col("_k") % F.col("_blocks")).alias("source_block")), "drawn-blocks")
    # Which documents reach into drawn blocks is found from numbers; only their words are cut.
    reached = at.where("_n > 0").select("*", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("_n") - 1) / size))).alias("source_block"))
    asked = reached.join(draws.select("source", "source_block").distinct(), ["source", "source_block"], "left_semi").select("source", "pos", "at", "n_stream").distinct()
    cut = _slices(mine.select("source", "pos", "words").join(asked, ["source", "pos"]), size)
    rows = cut.join(draws, ["source", "source_block"])
    return rows.select("block_no", "source", "source_block", "at", F.posexplode("tokens").alias("_i", "token")).select("block_no", "source", "source_block", (F.col("at") + F.col("_i")).alias("g"), "token")


def per_document(docs: DataFrame, weights: dict[str, float], n_docs: int, seed: int | str) -> DataFrame:
    """n_docs documents, each of a source drawn by weight; a source that runs out starts again. Adds doc_no."""
    sources = [name for name, _ in normalized(weights)]
    rows = docs.where(F.col("source").isin(sources))
    here = numbered(rows, "pos", "_place", by="source")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_docs"))
    draws = _draws(docs, n_docs, "doc_no", weights, seed).join(F.broadcast(sizes), "source")
    return draws.withColumn("_place", F.col("_k") % F.col("_docs")).join(here, ["source", "_place"]).drop("_k", "_docs", "_place")


def cycled(rows: DataFrame, at: str, n: int) -> DataFrame:
    """seq 0 to n - 1, each with the row number seq modulo the number of rows; at numbers the rows from 0."""
    size = rows.agg(F.count(F.lit(1)).alias("_size"))
    seq = rows.sparkSession.range(n).select(F.col("id").alias("seq")).join(F.broadcast(size)).withColumn(at, F.col("seq") % F.col("_size"))
    return seq.drop("_size").join(rows, at)


def sharded(df: DataFrame, key: str, n: int, shard: int | None = None, name: str = "shard") -> DataFrame:
    """df with its shard, key modulo n; only the rows of one shard if that is given."""
    out = df.withColumn(name, F.pmod(F.col(key), F.lit(n)).cast("long"))
    return out if shard is None else out.where(F.col(name) == shard)
