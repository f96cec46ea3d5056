"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are quantised to integers. Dimensions are terms: a block of candidates is held as one
postings list of (row, weight) for each dimension. A query takes its non-zero dimensions one at a
time and adds its weight times each posting to a dense array with a score for each candidate. The
best of a block are found by partition; the bests of all blocks are merged.

Queries and candidates are dealt to blocks by hash, and every pair of blocks is one group, so no task holds more
than two blocks. Every query meets every candidate once, as the contract asks. Sums that 64 bits might not hold, those of vectors
with a very large component, are worked out with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE = 256
TOP = 5
EVERY = 50
#: Bytes of a block of candidates and of a block of queries, at most about.
CANDIDATES, QUERIES = 16 << 20, 4 << 20
_LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int = SCALE) -> list[int]:
    """floor(scale * x) of finite numbers; a double of 2^53 or more is an integer already, so scale * x is taken of that."""
    return [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.tolist()]


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id and q of the vectors that take part: the integers floor(scale * x) as 64-bit numbers, or large, as decimals parted by spaces, where they don't fit 31 bits.

    Left out: rows without an id, and vectors that are null or hold a null, NaN or infinite component. Rows that repeat an id are rows
    of their own.
    """

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, kept, q, large, size = batch.column(0).to_pylist(), [], [], [], []
            for i, v in enumerate(batch.column(1).to_pylist()):
                if ids[i] is None or v is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all():
                    continue
                kept.append(i)
                size.append(len(x))
                small = bool((np.abs(x) * scale < 2.0**31).all())
                q.append(np.floor(x * scale).astype("<i8").tobytes() if small else None)
                large.append(None if small else " ".join(map(str, integers(x, scale))))
            n = len(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0).take(pa.array(kept, pa.int64())), pa.array(size, pa.int32()), pa.array(q, pa.binary()), pa.array(large, pa.string())],
                ["row", "vec_id", "size", "q", "large"],
            )
            row += n

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(quantise, "row long, vec_id long, size int, q binary, large string")


def postings(matrix: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """By dimension the rows with a weight and their weights; no row list where every row has one."""
    got = []
    for column in np.ascontiguousarray(matrix.T):
        rows = np.flatnonzero(column)
        got.append((None, column) if len(rows) == len(column) else (rows, column[rows]))
    return got


def accumulate(query: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], scores: np.ndarray) -> None:
    """Adds up one query's scores of all candidates, one non-zero term at a time; scores may be of 64 bits or objects."""
    scores[:] = 0
    for term in np.flatnonzero(query[: len(lists)]).tolist():
        rows, weights = lists[term]
        if rows is None:
            scores += query[term] * weights
        else:
            scores[rows] += query[term] * weights


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > least)
    return np.append(over, np.flatnonzero(scores == least)[: k - len(over)])


class _Block:
    """Vectors of a block in order of id: those of small components as a matrix, the others by themselves as Python integers."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.row, self.id = (rows.column(c).to_numpy() for c in ("row", "vec_id"))
        raws, large = rows.column("q").to_pylist(), rows.column("large").to_pylist()
        self.small = np.array([i for i, q in enumerate(raws) if q is not None], np.int64)
        self.width = max([len(raws[i]) // 8 for i in self.small] or [0])
        self.matrix = np.zeros((len(self.small), self.width), np.int64)
        for k, i in enumerate(self.small):
            self.matrix[k, : len(raws[i]) // 8] = np.frombuffer(raws[i], "<i8")
        self.large = {i: np.array(list(map(int, v.split())), object) for i, v in enumerate(large) if v is not None}
        self.most = int(np.abs(self.matrix).max()) if self.matrix.size else 0


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return sum(int(x) * int(y) for x, y in zip(a[:n], b[:n], strict=True))


def search(queries: _Block, candidates: _Block, k: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[int]]]:
    """For each query its id, row, and the positions of its k best candidates, itself left out, with their scores."""
    fits = queries.most * candidates.most * max(1, candidates.width) <= _LONG
    lists = postings(candidates.matrix if fits else candidates.matrix.astype(object))
    scores = np.zeros(len(candidates.small), np.int64 if fits else object)
    by_object = lists if not fits else postings(candidates.matrix.astype(object)) if queries.large else []
    wide = np.zeros(len(candidates.small), object)
    asked = [(i, queries.matrix[n], False) for n, i in enumerate(queries.small)] + [(i, v, True) for i, v in queries.large.items()]
    for i, query, large in asked:
        if large:
            accumulate(query, by_object, wide)
        else:
            accumulate(query if fits else query.astype(object), lists, scores)
        mine = wide if large else scores
        at = best(mine, k + 1)
        found = [(candidates.small[p], int(mine[p])) for p in at.tolist()] + [(p, _exact(query, v)) for p, v in candidates.large.items()]
        found = sorted(((-s, candidates.id[p], candidates.row[p], s) for p, s in found if candidates.row[p] != queries.row[i]))[:k]
        yield queries.id[i], queries.row[i], np.array([f[1] for f in found], np.int64), [f[3] for f in found]


def top_k(vectors: DataFrame, is_query: F.Column, k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each vector for whose vec_id is_query holds: query_id, rank, vec_id, score of its k best others, ties to the smaller vec_id.

    Vectors of other lengths than a query's count as padded with zeros. Which rows take part: quantised(). Rows that repeat an id are each a
    candidate, and each a query with k rows of its own; only the query's own row is left out. Scores are compared exactly; one that a long
    can't hold is given as the nearest long. Without a query or a candidate there are no rows.
    """
    rows = stored(quantised(vectors, scale, id_col, vector_col), "vectors")
    size = F.sum(8 * F.col("size").cast("long") + 32)
    held, asked = rows.agg(F.coalesce(size, F.lit(0)), F.coalesce(F.sum(F.when(is_query, 8 * F.col("size").cast("long") + 32)), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts, asks = max(cores, -(-held // CANDIDATES)), max(1, -(-asked // QUERIES))  # few candidates are still dealt to all cores
    block = F.xxhash64("row")
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    here = rows.select("row", "vec_id", "q", "large", F.pmod(block, F.lit(parts)).cast("long").alias("part"), cells(asks).alias("ask"))
    queries = rows.where(is_query).select("row", "vec_id", "q", "large", F.pmod(F.shiftright(block, 24), F.lit(asks)).cast("long").alias("in_ask"), cells(parts).alias("in_part"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query_row", "vec_id", "score", "high"]
        out: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            for query, row, ids, scores in search(_Block(left), _Block(right), k):
                out[0] += [query] * len(ids)
                out[1] += [row] * len(ids)
                out[2] += ids.tolist()
                out[3] += [min(max(s, -_LONG - 1), _LONG) for s in scores]
                out[4] += [f"{s + (1 << 2200):x}" if abs(s) > _LONG else None for s in scores]
        return pa.table([pa.array(c, pa.string() if n == "high" else pa.int64()) for c, n in zip(out, names, strict=True)], names)

    pairs = queries.groupBy("in_ask", "in_part").cogroup(here.groupBy("ask", "part")).applyInArrow(find, "query_id long, query_row long, vec_id long, score long, high string")
    # Scores beyond a long come with their digits, shifted to be positive and alike in length: they rank among themselves at either end.
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.desc_nulls_last("high"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every fiftieth vector of embeddings; see top_k() for nulls, ties and repeats."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
