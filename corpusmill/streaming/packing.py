"""Streams of documents packed into blocks, weighted draws in order, and polls for new rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.mixture import drawn
from ..operators.sampling import uniform


#: Tokens that a task gives out at a time.
TOGETHER = 1 << 16


def packed(docs: DataFrame, size: int, shards: int = 1) -> DataFrame:
    """source, shard, block_no and tokens of the full blocks that each source's words make as documents come in.

    docs is a stream with source, pos and text; a source's documents go to shards by pos, each of which fills blocks of its own, so that
    a large source isn't one task. The state of a shard is the words that don't fill a block yet and the next
    block's number; the checkpoint keeps it over restarts. Documents are taken as they come, those of one Arrow batch in order of pos, and
    blocks are given out as they fill: a task holds one batch's texts and the words of a few documents. Null texts have no words.
    """

    def fill(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, number = state.get if state.exists else ([], 0)
        rest = list(rest)
        for frame in frames:
            out = []
            for words in frame.sort_values("pos", kind="stable")["words"]:
                rest.extend(words.split(" ") if words else [])
                full = len(rest) // size
                for i in range(full):
                    out.append((*key, number, rest[i * size : (i + 1) * size]))
                    number += 1
                rest = rest[full * size :]
                if len(out) * size >= TOGETHER:
                    yield pd.DataFrame(out, columns=["source", "shard", "block_no", "tokens"])
                    out = []
            yield pd.DataFrame(out, columns=["source", "shard", "block_no", "tokens"])
        state.update((rest, number))

    rows = docs.select("source", F.pmod(F.col("pos"), F.lit(shards)).cast("long").alias("shard"), "pos", F.array_join(T.words("text"), " ").alias("words"))
    return rows.groupBy("source", "shard").applyInPandasWithState(
        fill, "source string, shard long, block_no long, tokens array<string>", "rest array<string>, number long", "append", GroupStateTimeout.NoTimeout
    )


def draws_in_order(ticks: DataFrame, weights: dict[str, float], seed: int, at: str = "pos") -> DataFrame:
    """pos, source and k: each tick of a stream draws a source by weight, and k numbers the draws of a source from 0.

    The state of a source is how often it has been drawn. Only ticks go through it; ticks of one Arrow batch are numbered in order of pos.
    """

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        for frame in frames:
            pos = np.sort(frame["pos"].to_numpy())
            yield pd.DataFrame({"pos": pos, "source": key[0], "k": np.arange(n, n + len(pos))})
            n += len(pos)
        state.update((int(n),))

    rows = ticks.select(F.col(at).alias("pos")).withColumn("source", drawn(uniform("pos", seed), weights))
    return rows.groupBy("source").applyInPandasWithState(number, "pos long, source string, k long", "n long", "append", GroupStateTimeout.NoTimeout)


def drawn_items(draws: DataFrame, items: DataFrame, at: str = "at", n: str = "n") -> DataFrame:
    """The item that each draw takes: the next one of its source, the first again after the last.

    items is a static table with source, at (from 0 in its source), n (items of the source) and anything else: documents, or
    packed blocks, whose draws give words in proportion to the weights.
    """
    sizes = items.select("source", F.col(n).alias("_n")).distinct()
    placed = draws.join(F.broadcast(sizes), "source").withColumn(at, F.col("k") % F.col("_n")).drop("_n")  # a row for each source
    return placed.join(items.drop(n), ["source", at])


def endless(spark: SparkSession, items: DataFrame, weights: dict[str, float], seed: int, rows_per_second: int = 100) -> DataFrame:
    """An endless stream of items: each tick draws a source by weight and takes its next item, starting again at its end. items as in drawn_items()."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("pos"))
    return drawn_items(draws_in_order(ticks, weights, seed), items)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, together: int | None = None) -> DataFrame:
    """Takes all that there is through the stream into the Parquet table at path, and gives the table. together bounds the rows of an Arrow batch."""
    conf, key = stream.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, before if together is None else str(together))
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(key, before)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def poll(spark: SparkSession, source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hands each batch of rows that is new since the last call to handle, once; a batch is repeated only if handle failed."""
    source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def poll_until(spark: SparkSession, source: Callable[[], DataFrame], checkpoint: str, handle: Callable[[DataFrame, int], None], ended: Callable[[], bool], rounds: int = 1000) -> int:
    """Polls until the producer has ended and nothing new is left; how many polls it took. An error if it hasn't ended after rounds."""
    for k in range(1, rounds + 1):
        over = ended()  # asked before the poll: what comes in until then is taken
        poll(spark, source(), checkpoint, handle)
        if over:
            return k
    raise TimeoutError(f"the producer has not ended after {rounds} polls")
