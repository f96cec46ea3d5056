"""Event files of training runs: records of a length, its checksum, a message and its checksum (masked CRC-32C), each message a protocol buffer."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import opened
from .readers import fields_of

#: Reversed polynomial of CRC-32C, and what its mask adds: fixed values of the format.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


_TABLE = _table()


def masked_crc(parts: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of each byte string: all strings take a byte at a time, the longest ones first."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(-sizes, kind="stable")
    starts = np.append(0, np.cumsum(sizes))[:-1][order]
    raw, crc = np.frombuffer(b"".join(parts), np.uint8), np.full(len(parts), 0xFFFFFFFF, np.uint32)
    live = len(parts) - np.searchsorted(sizes[order][::-1], np.arange(1, int(sizes.max()) + 1 if len(parts) else 0), side="left")  # how many are that long
    for at, n in enumerate(live.tolist()):
        crc[:n] = _TABLE[(crc[:n] ^ raw[starts[:n] + at]) & 0xFF] ^ crc[:n] >> 8
    crc = ~crc
    out = np.empty(len(parts), np.uint32)
    out[order] = (crc >> 15 | crc << 17) + np.uint32(_MASK)
    return out


def records(content: bytes) -> tuple[list[bytes], int]:
    """The messages of a file up to the first damaged record, and the bytes from there on: 0 if the file is whole."""
    heads, messages, claimed, at = [], [], [], 0
    while at + 12 <= len(content):
        (n,) = struct.unpack_from("<Q", content, at)
        if n > len(content) - at - 16:
            break
        heads.append(content[at : at + 8])
        messages.append(content[at + 12 : at + 12 + n])
        claimed.append((struct.unpack_from("<I", content, at + 8)[0], struct.unpack_from("<I", content, at + 12 + n)[0]))
        at += 16 + n
    sums = masked_crc(heads + messages)
    whole = 0
    for i, (a, b) in enumerate(claimed):
        if (int(sums[i]), int(sums[len(heads) + i])) != (a, b):
            break
        whole = i + 1
    return messages[:whole], len(content) - sum(16 + len(m) for m in messages[:whole])


def scalars_of(message: bytes) -> Iterator[tuple[str, int, float, float]]:
    """tag, step, time and value of the scalars of a message: plain ones, and tensors of one 32 or 64 bit number as newer writers have them."""
    step, time, summaries = 0, 0.0, []
    for number, value in fields_of(message):
        if number == 1:
            time = struct.unpack("<d", value)[0]
        elif number == 2:
            step = value
        elif number == 5:
            summaries.append(value)
    for summary in summaries:
        for number, value in fields_of(summary):
            if number != 1:
                continue
            got = dict(fields_of(value))
            if 1 not in got:
                continue
            if 2 in got:
                yield got[1].decode(), step, time, struct.unpack("<f", got[2])[0]
            elif 8 in got:
                tensor = dict(fields_of(got[8]))
                kind, packed = {1: ("<f", 5), 2: ("<d", 6)}.get(tensor.get(1), (None, 0))
                raw = tensor.get(4) or tensor.get(packed) if kind else None
                if raw is not None and len(raw) == struct.calcsize(kind):
                    yield got[1].decode(), step, time, struct.unpack(kind, raw)[0]


_READ = "run string, file string, tag string, step long, time double, value double, damaged_bytes long"


def read(spark: SparkSession, pattern: str) -> DataFrame:
    """run (the file's folder), file, tag, step, time and value of each scalar, and a row with damaged_bytes, else null, for each file that a damaged record ends early.

    Spark lists and reads the files, each in one task; a record counts only if both of its checksums hold.
    """

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                run, name = path.rsplit("/", 2)[-2:]
                messages, damaged = records(bytes(content))
                rows = [(run, name, *s, None) for m in messages for s in scalars_of(m)]
                if damaged:
                    rows.append((run, name, None, None, None, None, damaged))
                yield pd.DataFrame(rows, columns=["run", "file", "tag", "step", "time", "value", "damaged_bytes"]).astype({"step": "Int64", "damaged_bytes": "Int64"})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(take, _READ)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, kind: int, body: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(body)) if kind == 2 else b"") + body


def written(scalars: list[tuple[str, int, float, float]]) -> bytes:
    """The content of a file of scalars: tag, step, time and value."""
    messages = [
        _field(1, 1, struct.pack("<d", time)) + _field(2, 0, _varint(step)) + _field(5, 2, _field(1, 2, _field(1, 2, tag.encode()) + _field(2, 5, struct.pack("<f", value)))) for tag, step, time, value in scalars
    ]
    heads = [struct.pack("<Q", len(m)) for m in messages]
    sums = masked_crc(heads + messages).astype("<u4")
    n = len(messages)
    return b"".join(h + sums[i].tobytes() + m + sums[n + i].tobytes() for i, (h, m) in enumerate(zip(heads, messages, strict=True)))


class _Message(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Message:
        """The runs of a task, each a file of its own under a name that no reader takes until the job is through."""
        held: dict[str, list] = {}
        for r in rows:
            held.setdefault(r["run"], []).append((r["tag"], r["step"], r["time"] or 0.0, r["value"]))
        task, files = TaskContext.get(), []
        for run, scalars in held.items():
            name = f"{run}/events.out.tfevents.{self.job}.{task.partitionId()}"
            system, inside = opened(f"{self.path}/_{self.job}/{task.taskAttemptId()}/{name}")
            system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inside) as f:
                f.write(written(scalars))
            files.append((inside, name))
        return _Message(files)

    def commit(self, messages: list[_Message | None]) -> None:
        system, inside = opened(self.path)
        for message in messages:
            for held, name in message.files if message else ():
                system.create_dir(f"{inside}/{name}".rsplit("/", 1)[0], recursive=True)
                system.move(held, f"{inside}/{name}")
        self._clear()

    def abort(self, messages: list[_Message | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inside = opened(f"{self.path}/_{self.job}")
        if system.get_file_info(inside).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(inside)


class EventFiles(DataSource):
    """Scalars to event files: a folder for each run, a file for each task that has rows of it."""

    @classmethod
    def name(cls) -> str:
        return "corpusmill_events"

    def schema(self) -> str:
        return "run string, tag string, step long, time double, value double"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write(scalars: DataFrame, path: str) -> None:
    """Writes run, tag, step, time and value to files below path, by tasks; a run's rows in one task stand in order of step and tag."""
    scalars.sparkSession.dataSource.register(EventFiles)
    rows = scalars.select("run", "tag", F.col("step").cast("long").alias("step"), F.col("time").cast("double").alias("time"), F.col("value").cast("double").alias("value"))
    rows.repartition("run").sortWithinPartitions("run", "step", "tag").write.format(EventFiles.name()).mode("append").save(path)
