"""How often the items of texts stand in the whole corpus, given back to every text in the order of its items.

Texts are taken block by block. A block's different items are dealt to buckets by hash, packed, with how often each stands in the block; its
texts are the numbers of their items. A bucket's items of all blocks come together and are summed, and the sums go back as one packed row for each
bucket and block. The task that gets a block's sums opens the stored file that has its texts, so what is shuffled is each block's different items
and their sums, whatever the number of texts that have them: a frequent item is one of a block's items like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import opened
from ..sources.tables import stored

#: Bytes of text of a block, but for its last text, and texts whose numbers are packed together.
BLOCK, TOGETHER = 4 << 20, 256
#: Buckets of items for each shuffle partition of the session.
BUCKETS = 4


def _pressed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _loose(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _packed(items: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress("\n".join(items).encode())


def _unpacked(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")


class _Numbers(dict):
    """Numbers items in order of first sight."""

    def __missing__(self, item):
        n = self[item] = len(self)
        return n

    def of(self, items: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.int64, len(items))


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about BLOCK bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + BLOCK, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _lists(at: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.concat_arrays([values]))  # without the slice's offset


def _blocks(texts: DataFrame, items: Callable[[str], list[str]]) -> DataFrame:
    """The stored blocks: a row for each bucket (bucket, items, times) and one for each TOGETHER texts (keys, n, the number of each one's items, and codes)."""
    spark = texts.sparkSession
    buckets, kind = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), texts.dtypes[0][1]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        names = ["block", "bucket", "items", "times", "keys", "n", "codes"]
        for batch in (part for whole in batches for part in _cut(whole)):
            numbers, keys = _Numbers(), batch.column(0)
            held = [numbers.of(items(t)) if t else np.zeros(0, np.int64) for t in batch.column(1).to_pylist()]
            if not numbers:
                continue
            listed = list(numbers)
            bucket = np.fromiter((zlib.crc32(i.encode()) % buckets for i in listed), np.int64, len(listed))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(listed), np.int64)
            place[order] = np.arange(len(listed))
            times = np.bincount(np.concatenate(held), minlength=len(listed))[order]
            here, starts = np.unique(bucket[order], return_index=True)
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(listed)]))
            ordered, m = [listed[i] for i in order.tolist()], len(here)
            packed = pa.array([_packed(ordered[i:j]) for i, j in cuts], pa.binary()), pa.array([_pressed(times[i:j]) for i, j in cuts], pa.binary())
            none = [pa.nulls(m, pa.list_(keys.type)), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(here, pa.int64()), *packed, *none], names)
            at = [*range(0, len(held), TOGETHER), len(held)]
            n, k = pa.array([len(h) for h in held], pa.int64()), len(at) - 1
            codes = pa.array([_pressed(place[np.concatenate(held[i:j])]) for i, j in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), _lists(at, keys), _lists(at, n), codes], names)
            number += 1

    cores = spark.sparkContext.defaultParallelism
    rows = texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores, F.xxhash64(texts.columns[0]))
    schema = f"block long, bucket long, items binary, times binary, keys array<{kind}>, n array<long>, codes binary"
    return stored(rows.mapInArrow(split, schema), "item-blocks")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, file, bucket and sums of rows in order of bucket: how often each item of the block and bucket stands anywhere.

    Of a bucket's rows only the places of their items among its different ones are held, four bytes each, and rows leave TOGETHER at a time.
    """
    now, numbers, sums, rows = None, _Numbers(), np.zeros(0, np.int64), []

    def given() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), TOGETHER):
            part = rows[i : i + TOGETHER]
            out = pa.array([_pressed(sums[places]) for _, _, places in part], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part]), pa.array([now] * len(part), pa.int64()), out], ["block", "file", "bucket", "sums"])

    for batch in batches:
        for row in range(batch.num_rows):
            bucket, block, file, items, times = (batch.column(i)[row].as_py() for i in range(5))
            if bucket != now:
                yield from given()
                now, numbers, sums, rows = bucket, _Numbers(), np.zeros(0, np.int64), []
            places = numbers.of(_unpacked(items))
            if len(sums) < len(numbers):
                sums = np.concatenate([sums, np.zeros(2 * len(numbers) - len(sums), np.int64)])
            sums[places] += _loose(times)  # a block's items are different
            rows.append((block, file, places.astype(np.int32)))
    yield from given()


def valued(texts: DataFrame, items: Callable[[str], list[str]], value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """texts' first column and values, what value makes of a text's items: it is given, in their order, how often each one stands in all texts.

    texts has a key and a text; items says what the items of a text are, which hold no line feed. Texts without items are left out.
    """
    key, kind = texts.dtypes[0]
    table = _blocks(texts, items)
    rows = table.where("bucket is not null").select("bucket", "block", F.col("_metadata.file_path").alias("file"), "items", "times")
    sums = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed, "block long, file string, bucket long, sums binary")

    def finish(group: tuple, table: pa.Table) -> pa.Table:
        total = np.concatenate([_loose(raw) for raw in table.column("sums").take(pc.sort_indices(table.column("bucket"))).to_pylist()])
        store, path = opened(group[1].as_py())
        with store.open_input_file(path) as f:
            held = pq.read_table(f, columns=["bucket", "keys", "n", "codes"], filters=(pc.field("block") == group[0].as_py()) & pc.field("bucket").is_null())
        n = pc.list_flatten(held.column("n")).to_numpy()
        ends = np.cumsum(n)
        of = np.split(total[np.concatenate([_loose(raw) for raw in held.column("codes").to_pylist()])], ends[:-1])
        each = [value(t) for t in of]
        at = np.concatenate([[0], np.cumsum([len(v) for v in each])])
        got = pa.table({key: pc.list_flatten(held.column("keys")), "values": _lists(at.tolist(), pa.array(np.concatenate(each), pa.float64()))})
        return got.filter(pa.array(n > 0))

    return sums.groupBy("block", "file").applyInArrow(finish, f"`{key}` {kind}, `values` array<double>")
