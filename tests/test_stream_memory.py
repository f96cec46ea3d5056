"""What a stream's task gives out at a time is bounded, however much one trigger brings."""

from __future__ import annotations

import pandas as pd

from pyspark.sql.streaming.state import GroupStateTimeout

from corpusmill.plans import streams
from corpusmill.streaming import mixture, packing


class Value:
    def __init__(self):
        self.held = None

    exists = lambda self: self.held is not None
    get = lambda self: self.held

    def update(self, held):
        self.held = held

    put = update

    def clear(self):
        self.held = None


class Map(dict):
    getValue = dict.__getitem__  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815
    removeKey = dict.pop  # noqa: N815
    iterator = dict.items


class Handle:
    getValueState = getListState = lambda self, *_: Value()  # noqa: E731, N815
    getMapState = lambda self, *_: Map()  # noqa: E731, N815


def _frame(n, source="en"):
    return pd.DataFrame({"source": source, "pos": range(n), "text": ["a b c d " * 64] * n, "ended": [False] * (n - 1) + [True]})


def test_packed_blocks_leave_in_bounded_frames():
    packing = mixture.Packing(mixture.Draws({"en": 1.0}, 1, 1), 128, None, 16, mixture.split_words, True)
    packing.init(Handle())
    got = list(packing.handleInputRows(("en", 0), iter([_frame(2000)]), None))
    assert sum(map(len, got)) == 2 * 2000 and max(map(len, got)) * 128 <= mixture.TOGETHER + 16 * 256


def test_shared_blocks_leave_in_bounded_frames_and_queues_in_chunks():
    packing = mixture.SharedPacking({"en": 0.5, "fr": 0.5}, 128, 1, None, 16, mixture.split_words, True)
    packing.init(Handle())
    assert list(packing.handleInputRows((0,), iter([_frame(2000)]), None)) == []  # all of en may wait for fr's first document
    assert max(len(texts) for (texts,) in packing.queues.values()) <= mixture.CHUNK_TEXTS
    got = list(packing.handleInputRows((0,), iter([_frame(1000, "fr")]), None))
    assert sum(len(tokens) for frame in got for tokens in frame["tokens"]) == 256 * (1999 + 999)
    assert max(map(len, got)) * 128 <= mixture.TOGETHER + 16 * 256


def test_parts_follow_the_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(100)] + [(None, "y")], "pos long, text string")
    assert streams._starts(docs) == [0, 34, 67]
    assert streams._starts(docs, 1000) == list(range(0, 100, 10))
    assert streams._starts(docs.limit(0)) == []


def test_waiting_texts_are_compressed_and_in_order():
    frame = _frame(2000)
    frame.loc[5, ["pos", "text"]] = None
    held = mixture._waiting(iter([frame[1000:], frame[:1000]]))
    assert sum(len(text) for _, _, text, _ in held if text) < frame["text"].str.len().sum() / 4
    assert [pos for pos, *_ in reversed(held)] == [*range(5), *range(6, 2000), None]
    assert mixture._text(held[-1][2]) == frame["text"][0] and held[1][3] and held[0][2] is None


def test_batches_of_a_stream_are_bounded(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).selectExpr("id", "0 AS k")

    def sizes(key, frames, state):
        yield from [pd.DataFrame({"n": [len(frame)]}) for frame in frames]

    each = stream.groupBy("k").applyInPandasWithState(sizes, "n long", "n long", "append", GroupStateTimeout.NoTimeout)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [r.n for r in packing.run_to_end(each, str(tmp_path / "out"), str(tmp_path / "checkpoint"), together=7).collect()]
    assert sum(got) == 100 and max(got) <= 7
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
