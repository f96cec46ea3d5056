"""Kept tables, chunks, listings, event files, table functions and the registry of evaluators."""

from __future__ import annotations

import os
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import registry
from corpusmill.sources import events, files, stores, tablefunctions

ROWS = "run string, step long, value double"


def files_of(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upsert_replaces_only_what_it_touches(spark, tmp_path):
    path = f"{tmp_path}/summary"
    first = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("b", None, 4.0), ("c", 1, 5.0)], ROWS)
    assert stores.upsert(first, f"file://{path}", ["run", "step"], "run") == 3
    before = files_of(path)
    second = spark.createDataFrame([("a", 2, 20.0), ("a", 3, 30.0), ("b", None, 40.0), ("b", None, 39.0)], ROWS)
    want = sorted([("a", 1, 1.0), ("a", 2, 20.0), ("a", 3, 30.0), ("b", 1, 3.0), ("b", None, 40.0), ("c", 1, 5.0)], key=str)
    for _ in range(2):
        assert stores.upsert(second, f"file://{path}", ["run", "step"], "run", latest="value") == 2
        assert sorted(map(tuple, spark.read.schema(ROWS).parquet(path).select("run", "step", "value").collect()), key=str) == want
    after = files_of(path)
    assert {f: t for f, t in before.items() if "run=c" in f} == {f: t for f, t in after.items() if "run=c" in f}
    assert stores.upsert(first.where("false"), f"file://{path}", ["run", "step"], "run") == 0
    with pytest.raises(ValueError):
        stores.upsert(spark.createDataFrame([(None, 1, 1.0)], ROWS), f"file://{path}", ["run", "step"], "run")


def test_upsert_into_buckets(spark, tmp_path):
    path, rng, held = f"file://{tmp_path}/buckets", random.Random(1), {}
    for _ in range(4):
        rows = [(rng.randint(0, 60), rng.randint(0, 3), rng.random()) for _ in range(50)]
        batch = {(a, b): v for a, b, v in rows}
        held |= batch
        df = spark.createDataFrame([(a, b, v) for (a, b), v in batch.items()], "a long, b long, v double").withColumn("bucket", stores.bucket_of(["a", "b"], 8))
        stores.upsert(df, path, ["a", "b"], "bucket")
    got = spark.read.parquet(path)
    assert {(r.a, r.b): r.v for r in got.collect()} == held and got.count() == len(held)


def test_cache_fills_itself(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None), (5, "")], "k long, text string")
    first = stores.cached(texts.where("k < 3"), path, T.words("text"), buckets=4)
    assert {r.k: (r.value, r.from_cache) for r in first.collect()} == {1: (["a", "b"], False), 2: (["c"], False)}
    second = {r.k: (r.value, r.from_cache) for r in stores.cached(texts, path, F.array(F.lit("other")), buckets=4).collect()}
    assert second == {1: (["a", "b"], True), 2: (["c"], True), 3: (["a", "b"], True), 4: (None, None), 5: (["other"], False)}
    assert spark.read.parquet(path).count() == 3


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/batches"
    for number, n in ((0, 3), (1, 5), (1, 5), (0, 3)):
        stores.batch_once(spark.range(n), path, number)
    assert sorted((r.batch, r.id) for r in spark.read.parquet(path).collect()) == [(0, i) for i in range(3)] + [(1, i) for i in range(5)]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_of_bounded_bytes(spark, tmp_path, seed):
    """Rows of any size: empty, null, a bit over half, larger than a chunk."""
    rng, size = random.Random(seed), 400
    sizes = [rng.choice([0, 1, 10, 10, 60, 150, 191, 192, 193, 200, 392, 393, 1000, None]) for _ in range(120)]
    df = spark.createDataFrame([(i, None if n is None else "x" * n, 7) for i, n in enumerate(sizes)], "id long, text string, _bytes int").drop("_bytes").repartition(5)
    path = f"file://{tmp_path}/chunks"
    index = sorted(map(tuple, stores.byte_chunks(df, path, "id", size, F.octet_length("text")).collect()))
    rows = spark.read.parquet(f"{path}/rows").withColumn("file", F.input_file_name()).collect()
    assert sorted((r.row_no, r.id) for r in rows) == [(i, i) for i in range(120)]
    held = {}
    for r in rows:
        held.setdefault((r.chunk, r.file), []).append(r)
    assert len(held) == len(index) == len({c for c, _ in held})
    for of in held.values():
        n = sum(len(r.text or "") + stores.ROW for r in of)
        assert n <= size or len(of) == 1
    at = 0
    for chunk, first, n, _ in index:
        assert first == at and sorted(r.row_no for r in rows if r.chunk == chunk) == list(range(first, first + n))
        at += n
    asked = spark.createDataFrame([(i,) for i in (0, 3, 57, 119, 120, 5000)], "row_no long")
    assert sorted((r.row_no, r.id) for r in stores.rows_at(asked, path).collect()) == [(i, i) for i in (0, 3, 57, 119)]


def test_chunks_are_full_and_opened_by_tasks(spark, tmp_path):
    """No file more than the bytes and the ranges ask for, and no listing of the folders by Spark."""
    path = f"file://{tmp_path}/chunks"
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 100 - stores.ROW).alias("text")).repartition(5)
    index = stores.byte_chunks(df, path, "id", 1000, F.octet_length("text"))
    assert 100 <= index.count() <= 104  # four ranges
    assert index.agg(F.max("bytes")).first()[0] == 1000
    asked = spark.createDataFrame([(i,) for i in (0, 3, 577, 999, 1000)], "row_no long")
    got = stores.rows_at(asked, path)
    assert not any("/rows/" in f for f in got.inputFiles())
    assert got.columns == ["row_no", "id", "text", "chunk"]
    chunks = {r.row_no: r.chunk for r in got.collect()}
    assert sorted(chunks) == [0, 3, 577, 999]
    for folder in (tmp_path / "chunks" / "rows").iterdir():  # the files of other chunks aren't opened
        if int(folder.name.removeprefix("chunk=")) not in chunks.values():
            (folder / "part.parquet").write_bytes(b"none")
    assert sorted((r.row_no, r.id) for r in stores.rows_at(asked, path).collect()) == [(i, i) for i in (0, 3, 577, 999)]


def test_rows_there_are_those_of_the_folders(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    df = spark.range(40).select("id", F.repeat(F.lit("x"), 92).alias("text"))
    index = {r.chunk: r for r in stores.byte_chunks(df, path, "id", 500, F.octet_length("text")).collect()}
    rows, last = tmp_path / "chunks" / "rows", max(index)
    assert sorted(r.row_no for r in stores.rows_there(spark, path).collect()) == list(range(40))
    (rows / f"chunk={last}").rename(rows / f"chunk={last + 7}")
    (rows / "chunk=0" / "again.parquet").write_bytes((rows / "chunk=0" / "part.parquet").read_bytes())
    (rows / "chunk=0" / ".cut").write_bytes(b"none")
    got = stores.rows_there(spark, path).groupBy("chunk").agg(F.count_distinct("file").alias("files"), F.count("*").alias("rows")).collect()
    assert {r.chunk: (r.files, r.rows) for r in got} == {(c + 7 if c == last else c): (1 + (c == 0), r.rows * (1 + (c == 0))) for c, r in index.items()}


def test_chunks_of_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    df = spark.createDataFrame([], "id long, text string")
    assert stores.byte_chunks(df, path, "id", 100, F.octet_length("text")).count() == 0
    assert stores.rows_at(spark.range(3).toDF("row_no"), path).count() == 0 and stores.rows_there(spark, path).count() == 0


def test_chunks_keep_types(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    df = spark.range(60).selectExpr(
        "id", "repeat('\u00e9', int(id % 40)) AS text", "timestamp_seconds(id) AS ts", "timestamp_ntz'2020-01-01 00:00:00' AS ntz", "date_add(date'2020-01-01', int(id)) AS day", "cast(id AS decimal(20,3)) AS dec",
        "array(id, null) AS a", "struct(id AS x, 'q' AS y) AS s", "map('k', id) AS m", "cast(null AS string) AS none", "encode('x', 'utf-8') AS raw", "float(id) AS f",
    )
    stores.byte_chunks(df, path, "id", 300, F.octet_length("text"))
    got = stores.rows_at(spark.range(60).toDF("row_no"), path).drop("row_no", "chunk")
    assert got.dtypes == df.dtypes and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_listing_of_a_tree(spark, tmp_path):
    for name in ("a/b/c/x.txt", "a/y.txt", "z.txt", "_hidden/q.txt", "a/.r", "empty/"):
        if name.endswith("/"):
            (tmp_path / name).mkdir(parents=True)
        else:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text("12345")
    got = {r.path.removeprefix(f"file://{tmp_path}/"): (r.folder, r.bytes) for r in files.listed(spark, f"file://{tmp_path}/").collect()}
    assert {p: b for p, (f, b) in got.items() if not f} == {"a/b/c/x.txt": 5, "a/y.txt": 5, "z.txt": 5}
    assert {p for p, (f, _) in got.items() if f} == {"a", "a/b", "a/b/c", "empty"}
    assert files.listed(spark, f"file://{tmp_path}", hidden=True).where("not folder").count() == 5


def test_paths_of_other_stores():
    assert files.uri("s3a://bucket/key") == "s3://bucket/key" and files.uri("file:/tmp/x") == "file:///tmp/x" and files.uri("/tmp/a:b") == "/tmp/a:b"
    system, inside = files.opened("s3a://bucket/some/key?region=us-east-1")
    assert (system.type_name, inside) == ("s3", "bucket/some/key")
    with pytest.raises(ValueError, match="nosuch"):
        files.opened("nosuch://x/y")


def slow_crc(raw):
    crc = 0xFFFFFFFF
    for byte in raw:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=8))
def test_checksums(parts):
    assert events.masked_crc(parts).tolist() == [slow_crc(p) for p in parts]


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_a_damaged_record_ends_its_file(data):
    scalars = data.draw(st.lists(st.tuples(st.text("aé/", min_size=1, max_size=5), st.integers(0, 2**40), st.floats(0, 1e9), st.floats(width=32, allow_nan=False)), max_size=6))
    content = events.written(scalars)
    messages, damaged = events.records(content)
    assert damaged == 0 and [s for m in messages for s in events.scalars_of(m)] == scalars
    if content:
        at, cut = data.draw(st.integers(0, len(content) - 1)), data.draw(st.booleans())
        broken = content[:at] if cut else content[:at] + bytes([content[at] ^ data.draw(st.integers(1, 255))]) + content[at + 1 :]
        before, ends = 0, 0
        for s in scalars:
            ends += len(events.written([s]))
            before += ends <= at
        messages, damaged = events.records(broken)
        assert len(messages) == before and damaged == len(broken) - sum(16 + len(m) for m in messages)


def test_event_files(spark, tmp_path):
    rows = [("r1", "loss", i, i / 4, 1.0 / (i + 1)) for i in range(30)] + [("r2", "accuracy", 5, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "run string, tag string, step long, time double, value double").repartition(3)
    path = f"file://{tmp_path}/logs"
    events.write(df, path)
    events.write(df.where("run = 'r2'").withColumn("step", F.lit(6)), path)
    assert not [d for d in os.listdir(f"{tmp_path}/logs") if d.startswith("_")]
    got = sorted((r.run, r.tag, r.step, r.time, r.value) for r in events.read(spark, f"{path}/*/events*").collect())
    f32 = lambda x: struct.unpack("<f", struct.pack("<f", x))[0]
    assert got == sorted([(a, b, c, d, f32(e)) for a, b, c, d, e in rows] + [("r2", "accuracy", 6, 0.0, 0.5)])
    file = next((tmp_path / "logs" / "r1").iterdir())
    file.write_bytes(file.read_bytes()[:-3])
    cut = events.read(spark, f"{path}/r1/events*").collect()
    assert sum(r.value is not None for r in cut) == 29 and [r.damaged_bytes > 0 for r in cut if r.value is None] == [True]


def test_scalars_as_tensors():
    """What newer writers put out: tensors of one number, raw or listed."""
    field = events._field
    for kind, number, raw in ((1, 5, struct.pack("<f", 0.25)), (2, 6, struct.pack("<d", 0.25)), (1, 4, struct.pack("<f", 0.25)), (2, 4, struct.pack("<d", 0.25))):
        tensor = field(1, 0, bytes([kind])) + field(number, 2, raw)
        message = field(2, 0, bytes([9])) + field(5, 2, field(1, 2, field(1, 2, b"loss") + field(8, 2, tensor)))
        assert list(events.scalars_of(message)) == [("loss", 9, 0.0, 0.25)]


def test_table_functions(spark):
    tablefunctions.register(spark)
    docs = spark.createDataFrame([(1, 0, " a b\n\n c "), (1, 1, "d"), (2, 0, None), (3, 0, "x y z")], "key long, at int, text string")
    lines = spark.sql("SELECT * FROM corpus_lines(TABLE(SELECT * FROM {d}) PARTITION BY key ORDER BY (at))", d=docs).collect()
    assert sorted(map(tuple, lines)) == [(1, 0, "a b", 2), (1, 1, "c", 1), (1, 2, "d", 1), (3, 0, "x y z", 3)]
    blocks = spark.sql("SELECT * FROM corpus_blocks(TABLE(SELECT * FROM {d}) PARTITION BY key ORDER BY (at), 3)", d=docs).collect()
    assert sorted(map(tuple, blocks)) == [(1, 0, ["a", "b", "c"]), (1, 1, ["d"]), (3, 0, ["x", "y", "z"])]


def test_a_failing_evaluator_gives_a_row_without_value(spark, tmp_path):
    spark.createDataFrame([("a", -1.0), ("b", -2.0)], "dataset string, logp double").write.parquet(f"{tmp_path}/good")
    spark.createDataFrame([("a", "no number")], "dataset string, logp string").write.parquet(f"{tmp_path}/bad")
    entries = [(1, "perplexity", f"{tmp_path}/good"), (1, "perplexity", f"{tmp_path}/bad"), (2, "perplexity", f"{tmp_path}/none"), (2, "unheard", f"{tmp_path}/good"), (3, "geometric_mean", f"{tmp_path}/good")]
    got = registry.evaluated_all(spark, entries).collect()
    assert sorted((r.step, r.evaluator, r.key) for r in got if r.error is None) == [(1, "perplexity", "a"), (1, "perplexity", "b"), (3, "geometric_mean", "a"), (3, "geometric_mean", "b")]
    failed = [r for r in got if r.error is not None]
    assert len(failed) == 3 and all(r.value is None for r in failed)
    with pytest.raises(ValueError):
        registry.evaluator("perplexity")(lambda rows: rows)


@pytest.mark.parametrize(
    ("name", "schema", "rows", "want"),
    [
        ("candidate_mass", "slot string, item_id int, cand string, logp double", [("s", 1, "c", 0.0), ("s", 2, "c", -1e9)], {"s": 0.5}),
        ("category_mass", "item_id int, category string, logp double", [(1, "n", 0.0), (1, "n", 0.0), (2, "n", 0.0)], {"n": 1.5}),
        ("chain_probability", "item int, cand string, logp double", [(1, "a", 0.0), (1, "a", -1e9), (1, "b", 0.0)], {"mean": 0.5}),
        ("transitivity_masses", "structure string, verb_class string, mass double", [("o", "t", 1.0), ("o", "t", 3.0)], {f"{k}/{s}": 2.0 for k in ("o/t", "o/ALL", "ALL/ALL") for s in ("mean", "median")}),
        ("odds_delta", "layer int, odds double, delta double", [(1, 2.0, 1.0), (1, 4.0, 1.0)], {"1/odds_mean": 3.0, "1/odds_std": 1.0, "1/delta_mean": 1.0, "1/delta_std": 0.0}),
        ("token_profile", "item int, cond string, tok_pos int, token string, surprisal double", [(1, "x", 0, "a", 2.0), (1, "x", 1, "b", 4.0)], {"x/2/0": 2.0, "x/2/1": 4.0}),
        ("tail_losses", "run string, tag string, step int, value double", [("r", "t", 1, 9.0), ("r", "t", 2, 5.0)], {"r/t": 5.0}),
        ("within_item_interval", "item int, filler int, gap int, y double", [(i, f, g, float(i * f * g)) for i in (1, 2, 3) for f in (0, 1) for g in (0, 1)], None),
        ("paired_test", "src array<double>, orc array<double>", [([1.0, 2.0], [2.0, 2.5]), ([1.0, 2.0], [4.0, 2.25])], None),
        ("density_overlap", "side string, value double", [("base", 1.0), ("base", 2.0), ("other", 1.0), ("other", 2.0)], None),
        ("filler_gap_model", "item int, filler int, gap int, y double", [(i, f, g, float(i + f + (i * f * g) % 3)) for i in range(6) for f in (0, 1) for g in (0, 1)], None),
    ],
)
def test_evaluators_of_the_registry(spark, tmp_path, name, schema, rows, want):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/t")
    got = registry.evaluated(spark, 1, name, f"{tmp_path}/t").collect()
    assert got and all(r.error is None and r.evaluator == name for r in got)
    if want is not None:
        assert {r.key: r.value for r in got} == pytest.approx(want)
