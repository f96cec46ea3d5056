"""The packed mixture as a stream, against lists: over restarts, to the end, to a cap; a generator that goes on where it was stopped."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.sources.tables import new_folder
from corpusmill.streaming import mixture, packing

WEIGHTS, SCHEMA = {"a": 3.0, "b": 1.0, "none": 0.0}, "source string, shard int, pos long, text string, ended boolean"


def brute(docs, size, seed, shards, samples, rest):
    """docs by source in order of pos: the blocks of each shard, and the draws that take them."""
    draws, words = mixture.Draws(WEIGHTS, seed, shards), defaultdict(list)
    for source, pos, text in sorted((d for d in docs if d[2] is not None and d[0] in ("a", "b")), key=lambda d: d[1]):
        words[source, pos % shards] += text.split()
    numbers, k = {}, defaultdict(int)
    for b in range(20000):
        s = draws.source(b)
        numbers[s, k[s]] = b
        k[s] += 1
    out = []
    for (source, shard), of in words.items():
        for j in range(-(-len(of) // size)):
            block, n = of[j * size : (j + 1) * size], numbers[source, j * shards + shard]
            if (len(block) == size or rest) and (samples is None or n < samples):
                out.append((n, source, j * shards + shard, block))
    return sorted(out)


@pytest.mark.parametrize(("samples", "rest"), [(None, True), (25, True), (None, False)])
def test_packed_mixture_over_restarts(spark, samples, rest):
    rng = random.Random(5)
    docs = [(rng.choice(["a", "a", "b", "none", "other"]), pos, rng.choice([None, "", " x  y ", " ".join(f"w{pos}-{i}" for i in range(rng.randint(1, 40)))])) for pos in range(60)]
    folder, out, checkpoint = (new_folder(spark, n) for n in ("in", "out", "checkpoint"))
    parts = [docs[:20], docs[20:21], docs[21:60], None, [("a", 77, "after the end")]]
    for part in parts:
        rows = mixture.ends(spark, ["a", "b"], 2) if part is None else spark.createDataFrame([(s, None, p, t, False) for s, p, t in part], SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        got = mixture.run(mixture.packed_mixture(stream, WEIGHTS, 8, 3, 2, samples, together=4, rest=rest), out, checkpoint)
    assert sorted((r.block_no, r.source, r.source_block, r.tokens) for r in got.collect()) == brute(docs, 8, 3, 2, samples, rest)


def test_filled_mixture_starts_again(spark):
    blocks = [(3, "a", 0, ["x"] * 4), (9, "a", 2, ["y"] * 4), (11, "a", 4, ["z"]), (4, "b", 1, ["q"] * 4)]
    got = mixture.filled(spark.createDataFrame(blocks, mixture.SCHEMA), WEIGHTS, 30, 3, 4).collect()
    draws, k = mixture.Draws(WEIGHTS, 3, 1), defaultdict(int)
    full = {"a": [0, 2], "b": [1]}
    want = []
    for b in range(30):
        s = draws.source(b)
        want.append((b, s, full[s][k[s] % len(full[s])]))
        k[s] += 1
    assert sorted((r.block_no, r.source, r.source_block) for r in got) == want


def test_endless_items(spark):
    """An endless source: ticks take the next item of a drawn source, from the first again after the last."""
    items = spark.createDataFrame([("a", 0, 2, "x"), ("a", 1, 2, "y"), ("b", 0, 1, "z")], "source string, at long, n long, item string")
    stream = packing.endless(spark, items, WEIGHTS, 3, rows_per_second=50)
    query = stream.select("pos", "source", "at", "item").writeStream.format("memory").queryName("endless").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.table("endless").count() >= 20:
                break
    finally:
        query.stop()
    rows = sorted(map(tuple, spark.table("endless").collect()))
    taken = defaultdict(list)
    for _, source, at, item in rows:
        assert item == {("a", 0): "x", ("a", 1): "y", ("b", 0): "z"}[source, at]
        taken[source].append(at)
    assert len(rows) >= 20 and set(taken) == {"a", "b"}
    assert taken["a"] == [i % 2 for i in range(len(taken["a"]))] and not any(taken["b"])


def test_generator_goes_on(spark):
    from corpusmill.sources import generator

    slots = spark.createDataFrame([(0, 0, "the"), (0, 1, "a"), (1, 0, "cat"), (1, 1, "dog"), (1, 2, "owl"), (2, 0, "sees")], "slot int, at int, word string")
    out, checkpoint = new_folder(spark, "generated"), new_folder(spark, "checkpoint")
    counts = []
    for _ in range(4):  # each run is stopped after a batch of four rows
        stream = generator.sentences(generator.numbers(spark, generator.size(slots), per_batch=4, partitions=3), slots)
        counts.append(packing.run_to_end(stream, out, checkpoint).count())
    rows = sorted((r.number, r.sentence) for r in spark.read.parquet(out).collect())
    assert counts == [4, 6, 6, 6]
    assert rows == list(enumerate(["the cat sees", "the dog sees", "the owl sees", "a cat sees", "a dog sees", "a owl sees"]))
    assert generator.sentences(spark.range(2).select(F.col("id").alias("number")), slots).count() == 2


@pytest.mark.parametrize(("samples", "rest"), [(None, True), (6, False)])
def test_shared_buffer_hangs_on_order_only(spark, samples, rest):
    """Two ways to divide the documents into triggers give the blocks of the whole; what waits for slower sources isn't lost."""
    rng = random.Random(8)
    docs = [(rng.choice(["a", "a", "a", "b"]), pos, rng.choice([None, "", " ".join(f"w{pos}-{i}" for i in range(rng.randint(1, 25)))])) for pos in range(50)]
    want = []
    for shard in range(2):
        draws, words, numbered = mixture.Draws(WEIGHTS, f"3-{shard}", 1), [], []
        for source in ("a", "b"):
            number = -1
            for _, pos, text in (d for d in docs if d[0] == source and d[1] % 2 == shard and d[2] is not None):
                number = draws.after(number + 1, 0, source, 0)[0]
                numbered.append((number, text))
        for _, text in sorted(numbered):
            words += text.split()
        blocks = [words[i : i + 8] for i in range(0, len(words), 8)]
        blocks = [b for b in blocks if rest or len(b) == 8][:samples]
        want += [(shard, i, b) for i, b in enumerate(blocks)]
    for cuts in ([50], [7, 30, 31, 50]):
        folder, out, checkpoint = (new_folder(spark, n) for n in ("in", "out", "checkpoint"))
        begin = 0
        for cut in [*cuts, None]:
            rows = mixture.ends(spark, ["a", "b"], 2) if cut is None else spark.createDataFrame([(s, None, p, t, False) for s, p, t in docs[begin:cut]], SCHEMA)
            begin = cut
            rows.coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(SCHEMA).parquet(folder)
            got = mixture.run(mixture.packed_shared(stream, WEIGHTS, 8, 3, 2, samples, together=4, rest=rest), out, checkpoint)
        assert sorted((r.shard, r.block_no, r.tokens) for r in got.collect()) == want
