"""Readers and writers on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.sources import readers, writers


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two  \nthree")
    got = readers.nonempty_lines(spark, str(tmp_path / "a.txt")).orderBy("pos")
    assert [r["text"] for r in got.collect()] == ["one", "two", "three"]
    kept = readers.nonempty_lines(spark, str(tmp_path / "a.txt"), keep_spaces=True).orderBy("pos")
    assert [r["text"] for r in kept.collect()] == ["one", " two  ", "three"]
    both = readers.split_files(spark, {"train": str(tmp_path / "a.txt"), "test": str(tmp_path / "a.txt")})
    assert {r["split"]: r["count"] for r in both.groupBy("split").count().collect()} == {"train": 4, "test": 4}


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c\nd', None), (2, "", "x")], "id int, t string, u string")
    writers.csv(rows, str(tmp_path / "c"), ["id", "t"])
    got = readers.csv_typed(spark, str(tmp_path / "c"), "id INT, t STRING").orderBy("id").collect()
    assert got[0]["t"] == 'a "b", c\nd'
    assert {f.dataType.simpleString() for f in readers.csv_strings(spark, str(tmp_path / "c")).schema} == {"string"}
    named = readers.with_file_name(spark, str(tmp_path / "c"), readers.csv_strings)
    assert named.where("file_name is null").count() == 0


def test_json_forms(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"examples": [{"input": "a", "target_scores": {"b": 1.0, "c": 0.0}, "comment": "k"}, {"input": "d", "target_scores": {"e": 1}}]}))
    got = readers.cloze_examples(spark, str(tmp_path / "x.json")).orderBy("item").collect()
    assert got[0]["target_scores"] == {"b": 1.0, "c": 0.0} and got[1]["comment"] is None
    (tmp_path / "p").mkdir()
    row = {"UID": "u", "field": "f", "linguistics_term": "t", "pairID": "0", "sentence_good": "g", "sentence_bad": "b"}
    (tmp_path / "p" / "one.jsonl").write_text("\n".join(json.dumps(row | {"UID": f"u{i}", "pairID": str(i)}) for i in range(3)))
    assert {r["UID"] for r in readers.paradigms(spark, str(tmp_path / "p")).collect()} == {"u0"}
    for run, loss in (("r1", 1.0), ("r2", 2.0)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "train_metrics.json").write_text(json.dumps({"train_loss": loss}))
    got = readers.run_metrics(spark, str(tmp_path / "runs" / "*" / "train_metrics.json")).orderBy("run").collect()
    assert [(r["run"], r["train_loss"], r["val_loss"]) for r in got] == [("r1", 1.0, None), ("r2", 2.0, None)]


def test_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("out_dir: out/a\ntrain:\n  lr: 0.5\n")
    (tmp_path / "b.yaml").write_text("a: [1\n")
    got = {r["path"][-6:]: r["config"] for r in readers.yaml_documents(spark, str(tmp_path / "*.yaml"), "out_dir STRING, train STRUCT<lr: DOUBLE>").collect()}
    assert got["a.yaml"]["train"]["lr"] == 0.5 and got["b.yaml"]["out_dir"] is None
    keys = {r["path"][-6:]: r["out_dir"] for r in readers.yaml_key(spark, str(tmp_path / "*.yaml"), "out_dir").collect()}
    assert keys == {"a.yaml": "out/a", "b.yaml": None}


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(2, "c2", "o2"), (1, "c1", "o1")], "exp int, config string, out_dir string")
    writers.manifest(rows, str(tmp_path / "m"))
    got = readers.manifest(spark, str(tmp_path / "m")).orderBy("line").collect()
    assert [(r["line"], r["config"], r["out_dir"]) for r in got] == [(1, "c1", "o1"), (2, "c2", "o2")]
    assert writers.yaml_text(rows, ["exp", "config"]).where("exp = 1").first()["yaml"] == "exp: 1\nconfig: c1\n"


def test_checkpoints(spark):
    got = [r["step"] for r in readers.checkpoints(spark, ["m/checkpoint-1000", "m/checkpoint-200", "m/final"]).collect()]
    assert got == [200, 1000]
    with pytest.raises(ValueError):
        readers.checkpoints(spark, ["m/final"])
    epoch, batch = readers.epoch_and_batch(F.lit("epoch_3.pt"))
    assert spark.range(1).select(epoch.alias("e"), batch.alias("b")).first().asDict() == {"e": 3, "b": 10_000}
    files = spark.createDataFrame([("a/config.json",), ("a/x",), ("b/y",)], "path string")
    assert [r["folder"] for r in readers.model_folders(files, ["config.json"]).collect()] == ["a"]


def test_writers(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("pos"), F.concat(F.lit("l"), "id").alias("text"), F.concat(F.lit("m"), "id").alias("other"))
    writers.parallel_text(rows, {"text": str(tmp_path / "a"), "other": str(tmp_path / "b")}, "pos")
    a, b = ([r["text"] for r in readers.text_lines(spark, str(tmp_path / x)).orderBy("source", "pos").collect()] for x in "ab")
    assert [x[1:] for x in a] == [x[1:] for x in b]
    writers.chunks(rows.coalesce(1), str(tmp_path / "c"), 4)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3
    assert writers.append_new(rows, str(tmp_path / "d"), ["pos"]) == 10
    assert writers.append_new(rows.unionByName(rows), str(tmp_path / "d"), ["pos"]) == 0
    assert spark.read.parquet(str(tmp_path / "d")).count() == 10


def test_schemas(spark):
    rows = spark.createDataFrame([("s", "1", "t", 3)], "source string, pos string, text string, more int")
    assert schemas.conform(rows, "corpus").schema.simpleString() == "struct<source:string,pos:bigint,text:string>"
    with pytest.raises(ValueError):
        schemas.conform(rows.drop("pos"), "corpus")


def test_cache(spark):
    texts = spark.createDataFrame([("a b",), ("c",)], "text string")
    cached = texts.where("text = 'c'").select(F.sha1("text").alias("key"), F.array(F.lit("known")).alias("tokens"))
    got = {r["text"]: r["tokens"] for r in readers.token_cache(texts, cached, F.split("text", " ")).collect()}
    assert got == {"a b": ["a", "b"], "c": ["known"]}
