"""A generator of rows as a streaming data source with offsets: it goes on where its checkpoint says that it was stopped.

The source gives numbers, made by the tasks from the ends of their ranges; what a row holds is worked out from its number by expressions, so a
batch that is run again gives the same rows. Slots with words make sentences: the digits of a number, in the mixed base of the slots' sizes, choose the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows that a task makes at a time.
_ROWS = 50_000


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.rows, self.per_batch, self.split = (int(options[k]) for k in ("rows", "perbatch", "partitions"))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        """One batch further. After a restart the last batch's partitions are asked for first, which says where that was."""
        self.at = min(self.rows, self.at + self.per_batch)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["at"], end["at"]
        self.at = max(self.at, last)
        ends = np.linspace(first, last, min(self.split, max(1, last - first)) + 1).astype(int).tolist()
        return [InputPartition((a, b)) for a, b in zip(ends, ends[1:])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        for at in range(first, last, _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(last, at + _ROWS)), pa.int64())], ["number"])

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["at"])

    def stop(self) -> None:
        pass


class Numbers(DataSource):
    """Numbers from 0 to rows - 1, perBatch of them in each batch, made in partitions parts."""

    @classmethod
    def name(cls) -> str:
        return "corpusmill_numbers"

    def schema(self) -> str:
        return "number long"

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def numbers(spark: SparkSession, rows: int, per_batch: int, partitions: int | None = None) -> DataFrame:
    """A stream of the numbers from 0 to rows - 1, per_batch in each batch. A run to its end (availableNow) is one batch, so that it can be stopped after any."""
    spark.dataSource.register(Numbers)
    split = partitions or spark.sparkContext.defaultParallelism
    return spark.readStream.format(Numbers.name()).option("rows", rows).option("perBatch", per_batch).option("partitions", split).load()


def size(slots: DataFrame) -> int:
    """How many sentences there are: the product of the slots' numbers of words. slots has slot, at and word."""
    return math.prod(n for (n,) in slots.groupBy("slot").agg(F.count(F.lit(1))).select("count(1)").collect())  # a row for each slot


def sentences(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """number and sentence of each number of rows, the last slot's words changing fastest. The slots' words, a fixed list, are one row."""
    words = F.array_sort(F.collect_list(F.struct("at", "word")))
    each = slots.groupBy("slot").agg(F.transform(words, lambda w: w["word"]).alias("words"))
    listed = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "words"))), lambda s: s["words"]).alias("_slots"))
    one = rows.select("number").join(F.broadcast(listed))

    # From the last slot to the first: the remainder chooses the word, the quotient goes on.
    start = F.struct(F.col("number").alias("rest"), F.array().cast("array<string>").alias("got"))

    def step(state, words):
        n = F.size(words).cast("long")
        at = F.pmod(state["rest"], n)
        return F.struct(((state["rest"] - at) / n).cast("long").alias("rest"), F.concat(F.array(F.element_at(words, (at + 1).cast("int"))), state["got"]).alias("got"))

    chosen = F.aggregate(F.reverse("_slots"), start, step, lambda state: F.concat_ws(" ", state["got"]))
    return one.select("number", chosen.alias("sentence"))
