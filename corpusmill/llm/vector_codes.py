"""Compression of vectors to codes of their parts, found by partial-distance search.

Vectors of integers are cut into equal parts, each with a codebook of its own, which a few rounds of assignment and averaging fit. The nearest
entry of a part is found dimension by dimension, those in which the codebook varies most first. The entry nearest in the first dimensions is
measured in full; entries whose distance so far exceeds that are dropped by masks, and the rest go on to the next dimensions.
What strictly exceeds the best complete distance goes, so equal distances stay and the lowest index wins.

A round is one pass over the stored vectors: each task adds up its parts by entry, the sums of all tasks meet by entry, and the codebooks, whose size is
that of the parameters, go back to the tasks. Sums are of integers, so that the result doesn't hang on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_hot, stored, table
from .vector_search import integers

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors that are searched at a time: their distances to a codebook are 1 MB.
VECTORS = 512
#: Dimensions that are summed before the first entry is measured in full, and between droppings.
STEP = 4
#: Numbers up to this are handled as 64-bit integers, larger ones as Python's.
_SMALL = 1 << 20
LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, size and the integers floor(scale * x) of the vectors that take part: q as 32-bit numbers or, where one doesn't fit, large as decimals.

    Left out: vectors that are null or hold a null, NaN or infinite component.
    """

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, q, large = [], [], [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                if v is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all():
                    continue
                small = bool((np.abs(x) * scale < _SMALL).all())
                kept.append(i)
                size.append(len(x))
                q.append(np.floor(x * scale).astype("<i4").tobytes() if small else None)
                large.append(None if small else " ".join(map(str, integers(x, scale))))
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(size, pa.int32()), pa.array(q, pa.binary()), pa.array(large, pa.string())], ["vec_id", "label", "size", "q", "large"]
            )

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(quantise, f"vec_id {kinds['vec_id']}, label {kinds['label']}, size int, q binary, large string")


def matrix(q: list[bytes | None], large: list[str | None], width: int) -> np.ndarray:
    """Vectors as rows of width numbers, shorter ones padded with zeros: of 64 bits, or objects if one of them is large."""
    got = np.zeros((len(q), width), np.int64 if all(v is None for v in large) else object)
    for i, (raw, text) in enumerate(zip(q, large, strict=True)):
        v = np.frombuffer(raw, "<i4").astype(np.int64) if text is None else np.array(list(map(int, text.split())), object)
        got[i, : len(v)] = v
    return got


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS):
            part = batch.slice(at, VECTORS)
            column = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            yield part, matrix(column("q"), column("large"), width)


def descending_variance(book: np.ndarray) -> np.ndarray:
    """The dimensions of a codebook, that of the largest variance first."""
    return np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts the nearest entry of book, of equal ones the lowest, and its squared distance."""
    n, entries, kind = len(parts), len(book), parts.dtype
    order = descending_variance(book)
    x, c = parts[:, order], book[:, order].astype(kind, copy=False)
    rows = np.arange(n)
    so_far = np.zeros((n, entries), kind)
    for d in range(min(STEP, x.shape[1])):
        so_far += (x[:, d, None] - c[None, :, d]) ** 2
    guess = so_far.argmin(axis=1)
    complete = ((x - c[guess]) ** 2).sum(axis=1) if x.shape[1] else np.zeros(n, kind)
    # What is left is a list of (row, entry, distance so far), row by row and in order of entry.
    row, entry = np.nonzero(so_far <= complete[:, None])
    so_far = so_far[row, entry]
    for at in range(STEP, x.shape[1], STEP):
        for d in range(at, min(at + STEP, x.shape[1])):
            so_far = so_far + (x[row, d] - c[entry, d]) ** 2
        keep = so_far <= complete[row]
        row, entry, so_far = row[keep], entry[keep], so_far[keep]
        # The most promising entry of each row is measured in full: it may be nearer than the one before.
        starts = np.searchsorted(row, rows)
        least = np.minimum.reduceat(so_far, starts) if n else so_far
        best = np.flatnonzero(so_far == least[row])
        first = best[np.searchsorted(row[best], rows)]
        complete = np.minimum(complete, ((x - c[entry[first]]) ** 2).sum(axis=1))
    # The nearest entries are left with their whole distances; rows and entries are in order, so the first is the lowest.
    done = np.flatnonzero(so_far == complete[row])
    first = done[np.searchsorted(row[done], rows)]
    return entry[first], complete


def start(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The first codebooks: the parts of the vectors of the smallest ids; rows that share an id stand in order of their stored bytes. Null ids come last."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.col("large").asc_nulls_first(), F.hex("q")).limit(entries).toArrow()  # entries, a parameter
    width = rows.agg(F.max("size")).first()[0] or 0
    width += -width % parts
    whole = matrix(first.column("q").to_pylist(), first.column("large").to_pylist(), width)
    return np.split(whole, parts, axis=1)


def _text(numbers: np.ndarray) -> str:
    return ",".join(map(str, numbers.ravel().tolist()))


def sums(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n and sums (decimals joined by commas) of the parts nearest to each entry that has any, over all rows."""
    width = sum(b.shape[1] for b in books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for _, block in _blocks(batches, width):
            for i, (book, part) in enumerate(zip(books, np.split(block, len(books), axis=1), strict=True)):
                at = nearest(part, book)[0]
                n[i] += np.bincount(at, minlength=len(book))
                if part.dtype == object:
                    total[i] = total[i].astype(object)
                np.add.at(total[i], at, part)
        used = [(i, e) for i, k in enumerate(n) for e in np.flatnonzero(k).tolist()]
        columns = [pa.array([u[0] for u in used], pa.int32()), pa.array([u[1] for u in used], pa.int32()), pa.array([int(n[i][e]) for i, e in used], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([_text(total[i][e]) for i, e in used], pa.string())], ["part", "entry", "n", "sums"])

    def merge(key: tuple, tasks: pa.Table) -> pa.Table:
        total = [0] * books[key[0].as_py()].shape[1]
        for text in tasks.column("sums").to_pylist():
            total = [a + int(b) for a, b in zip(total, text.split(","), strict=True)] if total else total
        n = sum(tasks.column("n").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "entry": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "sums": [",".join(map(str, total))]})

    schema = "part int, entry int, n long, sums string"
    return rows.select("q", "large").mapInArrow(add, schema).groupBy("part", "entry").applyInArrow(merge, schema)


def averaged(books: list[np.ndarray], rows: list[tuple]) -> list[np.ndarray]:
    """books with floor(sum / n) for the entries that rows of sums() have; the others stay."""
    kind = object if any(b.dtype == object for b in books) else np.int64
    new = [b.astype(kind) for b in books]
    for part, entry, n, text in rows:
        mean = [int(v) // n for v in text.split(",")] if text else []
        if kind is not object and any(abs(v) >= _SMALL for v in mean):
            kind, new = object, [b.astype(object) for b in new]
        new[part][entry] = mean
    return new


def fitted(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after some rounds over rows, a stored table of whole_vectors(). What the driver holds is the codebooks."""
    books = start(rows, parts, entries)
    for _ in range(rounds):
        if len(books[0]):
            books = averaged(books, [tuple(r) for r in sums(rows, books).collect()])  # parts * entries rows
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of each row: the entries' numbers, two hex digits each (three and more for larger codebooks), and the squared distances summed up."""
    width, kinds = sum(b.shape[1] for b in books), dict(rows.dtypes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = max(2, len(f"{max(0, len(books[0]) - 1):x}"))
        for batch, block in _blocks(batches, width):
            text, error = [""] * len(block), [0] * len(block)
            for book, part in zip(books, np.split(block, len(books), axis=1), strict=True):
                entry, distance = nearest(part, book)
                text = [t + f"{e:0{digits}x}" for t, e in zip(text, entry.tolist(), strict=True)]
                error = [a + b for a, b in zip(error, distance.tolist(), strict=True)]
            error = [min(e, LONGEST) for e in error]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "q", "large").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """A row for each vector that takes part: vec_id, label, code, error, label_error (the errors of all rows of the label; null is a label), codebooks_sha256.

    Which vectors take part: whole_vectors(). Vectors shorter than the longest, or whose length parts doesn't divide, count as padded with zeros. Rows
    that repeat an id are rows of their own, a null id is passed on and comes last among the first codebooks. With fewer vectors than entries the
    codebooks are shorter. Components of any size are exact; an error or sum that a long can't hold is the largest long. An empty table gives no rows.
    """
    rows = stored(whole_vectors(vectors, scale, id_col, vector_col, label_col), "whole-vectors")
    books = fitted(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(_text(b) for b in books).encode()).hexdigest()
    codes = stored(coded(rows, books).withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "vector-codes")
    labels = codes.groupBy("_label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), F.lit(LONGEST)).cast("long").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    joined = joined_hot(codes, stored(labels, "label-errors"), ["_label"], "_rows", codes.count())
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors of embeddings; see compressed() for nulls, ties and repeats."""
    return compressed(table(spark, sf_dir, "embeddings")).drop("label")


def _sql(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> str:
    """The SQL of the query: two common tables a round."""
    near = """SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, c.entry, list_sum(list_transform(list_zip(p.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {book} c USING (part)) GROUP BY vec_id, part"""
    steps = [
        f"""v AS (SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"p AS (SELECT vec_id, label, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS q FROM v, range({parts}) t(part))",
        f"b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q FROM p QUALIFY entry < {entries})",
    ]
    for r in range(rounds):
        steps.append(f"n{r} AS MATERIALIZED ({near.format(book=f'b{r}')})")
        steps.append(f"""m{r} AS (SELECT part, entry, list(CAST(m AS BIGINT) ORDER BY i) AS q FROM (
    SELECT n.part, n.entry, i, floor(sum(p.q[i]) / count(*)) AS m FROM n{r} n JOIN p USING (vec_id, part), range(1, 1 + (SELECT max(len(q)) FROM p)) t(i) GROUP BY ALL) GROUP BY part, entry)""")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.q, b.q) AS q FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    last = near.format(book=f"b{rounds}")
    return f"""WITH {", ".join(steps)}, z AS MATERIALIZED ({last}),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN v USING (vec_id)"""


#: Ids are taken to be distinct and vectors of one length, which parts divides.
SQL = _sql()
