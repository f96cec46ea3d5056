"""The distinct words of a corpus, each worked on once and joined back to the documents.

Texts are split block by block. A block's distinct words are dealt to buckets by hash and numbered in that order; its
documents are the numbers of their words, compressed. A bucket's words of all blocks come together in one place, where each different word of
the corpus is worked on once, and what comes out goes back to every block that has the word, as one packed row for each block and
bucket. The task that gets a block's values opens the stored file that has its documents, so these aren't shuffled; what is shuffled
is each block's distinct words and their values. A group is a bucket or a block: a word that is in every text is one of
a block's words like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, Codes, blocks, opened, spread, stored

#: Bytes of distinct words that are worked on at a time.
WORK_BYTES = 1 << 20
#: Buckets of words for each shuffle partition of the session.
BUCKETS = 4
#: Bytes of text of a block, and documents that are compressed together.
BLOCK, TOGETHER = 2 * BLOCK_CHARS, 256
#: Buckets beyond which a block's text grows with them, up to eight times, so that a row of a block and bucket keeps its size.
FULL = 2048


def packed(parts: list[bytes]) -> bytes:
    """Byte strings as one: how many bytes a length takes, their number, their lengths, then all of them."""
    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    wide = 4 if len(parts) and lengths.max() > 255 else 1
    return zstandard.ZstdCompressor(level=3).compress(bytes([wide]) + len(parts).to_bytes(4, "little") + lengths.astype(f"<u{wide}").tobytes() + b"".join(parts))


def unpacked(raw: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    wide, n = raw[0], int.from_bytes(raw[1:5], "little")
    first = 5 + wide * n
    ends = (np.cumsum(np.frombuffer(raw, f"<u{wide}", n, 5), dtype=np.int64) + first).tolist()
    return [raw[i:j] for i, j in zip([first, *ends], ends)]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers under 2^32 byte by byte: all lowest bytes, then all second ones, and so on."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel()


def pressed(codes: list[np.ndarray], times: list[np.ndarray] | None) -> bytes:
    """The numbers of some documents' words; with times each document's numbers rise and are written as differences."""
    flat = np.concatenate(codes).astype(np.int64)
    if times is not None:
        flat = np.diff(flat, prepend=0) & 0xFFFFFFFF
    parts = [len(codes).to_bytes(4, "little"), _planes(np.array([len(c) for c in codes])), _planes(flat)]
    if times is not None:
        parts.append(_planes(np.concatenate(times)))
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def loose(raw: bytes, counted: bool) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """What pressed() was given."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(_unplaned(raw, n, 4), dtype=np.int64)
    total, cuts = int(ends[-1]) if n else 0, ends[:-1]
    flat = _unplaned(raw, total, 4 + 4 * n)
    if not counted:
        return np.split(flat, cuts), None
    return np.split(np.cumsum(flat, dtype=np.uint32), cuts), np.split(_unplaned(raw, total, 4 + 4 * n + 4 * total), cuts)


def _dealt(codes: Codes, buckets: int) -> tuple[list[int], list[bytes], np.ndarray]:
    """Which buckets the words fall into, each one's words packed, and the words' new numbers."""
    words = [w.encode() for w in codes]
    if not words:
        return [0], [packed([])], np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    bucket = np.fromiter((digest(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    here, starts = np.unique(bucket[order], return_index=True)
    sorted_words = [words[i] for i in order.tolist()]
    ends = [*starts[1:].tolist(), len(words)]
    return here.tolist(), [packed(sorted_words[i:j]) for i, j in zip(starts.tolist(), ends)], number


def split_blocks(docs: DataFrame, splitter: Callable[[], Callable[[str], list[str]]], counted: bool, id_col: str, text_col: str) -> DataFrame:
    """The stored table of blocks.

    A block has a row for each bucket (bucket, words), one at least, and one for each TOGETHER documents: doc_ids, n_bytes and pressed, the numbers of
    their words, in order or, if counted, each once and how often. splitter() gives, on the executor, the function that splits a text.
    """
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block_bytes = BLOCK * min(8, max(1, buckets // FULL))  # an Arrow batch at most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, block = splitter(), TaskContext.get().partitionId() << 36
        names = ["block", "bucket", "words", "doc_ids", "n_bytes", "pressed"]
        for batch, texts in blocks(batches, size=block_bytes):
            codes, held, times = Codes(), [], []
            for text in texts:
                held.append(codes.of(words_of(text)) if text else np.zeros(0, np.int32))
            here, words, number = _dealt(codes, buckets)
            for i, of in enumerate(held):
                held[i] = number[of]
                if counted:
                    held[i], n = np.unique(held[i], return_counts=True)
                    times.append(n)
            n, m, ids = len(texts), len(here), batch.column(0)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            at = [*range(0, n, TOGETHER), n]
            lists = lambda column: pa.ListArray.from_arrays(pa.array(at, pa.int32()), column)
            nothing = lambda k, column: pa.nulls(k, pa.list_(column.type))
            raw = pa.array([pressed(held[i:j], times[i:j] if counted else None) for i, j in zip(at, at[1:])], pa.binary())
            ids = pa.concat_arrays([ids])  # without the slice's offset
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(here, pa.int64()), pa.array(words, pa.binary()), nothing(m, ids), nothing(m, size), pa.nulls(m, pa.binary())], names)
            k = len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), lists(ids), lists(size), raw], names)
            block += 1

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"block long, bucket long, words binary, doc_ids array<{kind}>, n_bytes array<long>, pressed binary"
    return stored(spread(rows, "doc_id").mapInArrow(split, schema), "word-blocks")


def _parts(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    part, held = [], 0
    for w in words:
        part.append(w)
        held += len(w)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def worked(table: DataFrame, worker: Callable[[], Callable[[list[bytes]], list[bytes]]]) -> DataFrame:
    """block, file, bucket and values, packed, what worker()'s function gives for the words of each block and bucket. Each distinct word of the corpus is handed over once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now, rows = worker(), None, []

        def close() -> Iterator[pa.RecordBatch]:
            held = [unpacked(raw) for _, _, raw in rows]
            value: dict[bytes, bytes] = dict.fromkeys(w for words in held for w in words)
            for part in _parts(list(value), WORK_BYTES):
                value.update(zip(part, of(part), strict=True))
            out = [packed(list(map(value.__getitem__, words))) for words in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([now] * len(rows), pa.int64()), pa.array(out, pa.binary())], ["block", "file", "bucket", "values"]
            )

        for batch in batches:
            for bucket, block, file, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and rows:
                    yield from close()
                    rows = []
                now = bucket
                rows.append((block, file, raw))
        if rows:
            yield from close()

    words = table.where("bucket is not null").select("bucket", "block", F.col("_metadata.file_path").alias("file"), "words")
    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "block long, file string, bucket long, values binary")


def joined(values: DataFrame, counted: bool, finisher: Callable[..., pa.Table], schema: str) -> DataFrame:
    """For each block what finisher makes of its documents: their ids, their bytes, the numbers of their words and how often each stands there, and the words' values by number."""

    def finish(key: tuple, words: pa.Table) -> pa.Table:
        block, file = key[0].as_py(), key[1].as_py()
        value: list[bytes] = []
        for raw in words.column("values").take(pc.sort_indices(words.column("bucket"))).to_pylist():
            value += unpacked(raw)
        store, path = opened(file)
        with store.open_input_file(path) as f:
            docs = pq.read_table(f, columns=["bucket", "doc_ids", "n_bytes", "pressed"], filters=(pc.field("block") == block) & pc.field("bucket").is_null())
        codes, times = [], []
        for raw in docs.column("pressed").to_pylist():
            c, t = loose(raw, counted)
            codes += c
            times += t or []
        flat = lambda name: pc.list_flatten(docs.column(name))
        return finisher(flat("doc_ids"), flat("n_bytes"), codes, times, value)

    return values.groupBy("block", "file").applyInArrow(finish, schema)
