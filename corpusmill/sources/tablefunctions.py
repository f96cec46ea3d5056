"""Generators of rows as table functions: called from SQL over a table, part by part and in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


class Lines:
    """The lines of the texts of a part that aren't blank, stripped, numbered through the part, with the number of their words.

    The table has key and text; a null text has no lines. SELECT * FROM corpus_lines(TABLE(...) PARTITION BY key ORDER BY ...)
    """

    def __init__(self) -> None:
        self.n = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        for line in (row["text"] or "").split("\n"):
            if line := line.strip():
                yield row["key"], self.n, line, len(line.split())
                self.n += 1


class Blocks:
    """The words of the texts of a part in blocks of size, the last one shorter: key, block_no and tokens.

    SELECT * FROM corpus_blocks(TABLE(...) PARTITION BY key ORDER BY (...), size). A part's rest, under size words, is all that is held.
    """

    def __init__(self) -> None:
        self.rest: list[str] = []
        self.key, self.n, self.size = None, 0, 0

    def eval(self, row: Row, size: int) -> Iterator[tuple]:
        self.key, self.size = row["key"], size
        self.rest += (row["text"] or "").split()
        while len(self.rest) >= size:
            block, self.rest = self.rest[:size], self.rest[size:]
            yield self.key, self.n, block
            self.n += 1

    def terminate(self) -> Iterator[tuple]:
        if self.rest:
            yield self.key, self.n, self.rest


def register(spark: SparkSession) -> None:
    """Makes corpus_lines and corpus_blocks known to SQL."""
    spark.udtf.register("corpus_lines", F.udtf(Lines, returnType="key long, line_no int, line string, n_words int"))
    spark.udtf.register("corpus_blocks", F.udtf(Blocks, returnType="key long, block_no int, tokens array<string>"))
