"""Readers of the formats that corpora, evaluation sets and run results come in."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip
from ..operators.order import numbered
from ..schemas import SCHEMAS


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source (file), pos (order within the file) and text of each line.

    Spark keeps the order of a file's lines by split and row; pos is made of both, so it rises along the file but has gaps.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_at"))
    return rows.select("source", (F.col("_at") * (1 << 12) + F.monotonically_increasing_id() % (1 << 33)).alias("pos"), F.col("value").alias("text"))


def nonempty_lines(spark: SparkSession, path: str | list[str], keep_spaces: bool = False) -> DataFrame:
    rows = text_lines(spark, path)
    return rows.where(strip("text") != "") if keep_spaces else rows.withColumn("text", strip("text")).where("text <> ''")


def split_files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Lines of several files or folders with the name of their split."""
    out = None
    for name, path in files.items():
        part = text_lines(spark, path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return out


def csv_strings(spark: SparkSession, path: str | list[str], line_ends: bool = True) -> DataFrame:
    """A CSV file with header, all columns strings; quotes inside quotes are doubled. Line ends may stand in quotes, so that one task reads a whole file; without line_ends as many do as it has splits."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=line_ends)


def csv_typed(spark: SparkSession, path: str | list[str], schema: str | StructType, line_ends: bool = True) -> DataFrame:
    """A CSV file with header by schema, which may name one of schemas.py; line_ends as in csv_strings()."""
    schema = SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=line_ends)


def with_file_name(spark: SparkSession, path: str | list[str], reader: Callable[[SparkSession, str | list[str]], DataFrame]) -> DataFrame:
    """What the reader gives, with file_name and folder, the name of the folder that the file is in."""
    return reader(spark, path).select("*", F.col("_metadata.file_name").alias("file_name"), F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("folder"))


def cloze_examples(spark: SparkSession, path: str) -> DataFrame:
    """item, input, target_scores and comment of each example of nested JSON documents."""
    docs = spark.read.schema(SCHEMAS["cloze"]).json(path, multiLine=True)
    return docs.select(F.posexplode("examples").alias("item", "e")).select("item", "e.*")


def json_lines(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema)
    return reader.json(path)


def paradigms(spark: SparkSession, path: str) -> DataFrame:
    """Sentence pairs of JSON lines files with the attributes of each file's first record, and the record's place in the file."""
    rows = spark.read.schema(SCHEMAS["pairs"]).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    rows = rows.withColumn("item", F.col("_at") * (1 << 12) + F.monotonically_increasing_id() % (1 << 33))  # rises along the file, however it is split
    first = rows.groupBy("_file").agg(*(F.min_by(c, "item").alias(f"_{c}") for c in ("UID", "field", "linguistics_term")))
    joined = rows.drop("UID", "field", "linguistics_term").join(first, "_file")
    return joined.select(F.col("_UID").alias("UID"), F.col("_field").alias("field"), F.col("_linguistics_term").alias("linguistics_term"), "pairID", "sentence_good", "sentence_bad", "item")


def json_array(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def run_metrics(spark: SparkSession, pattern: str, schema: str = "train_loss DOUBLE, val_loss DOUBLE") -> DataFrame:
    """The metrics file of each run folder, with the run's name."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True)
    return rows.select(F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("run"), "*")


def yaml_documents(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """path and config, by schema, of YAML files; a file that can't be parsed has an empty config."""

    @F.pandas_udf("string")
    def as_json(contents: pd.Series) -> pd.Series:
        import yaml

        def one(content: bytes) -> str:
            try:
                got = yaml.safe_load(content.decode())
            except (yaml.YAMLError, UnicodeDecodeError):
                got = {}
            return json.dumps(got if isinstance(got, dict) else {}, default=str)

        return contents.map(one)

    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.from_json(as_json("content"), schema).alias("config"))


def yaml_key(spark: SparkSession, pattern: str, key: str) -> DataFrame:
    """path and the value of one top-level key, read as text; null if it isn't there."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.regexp_extract("value", rf"(?m)^{key}:\s*(.+?)\s*$", 1)
    return files.select("path", F.nullif(F.regexp_replace(found, "^['\"]|['\"]$", ""), F.lit("")).alias(key))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """config and out_dir of a tab-separated manifest, numbered from 1; its header starts with #."""
    rows = text_lines(spark, path).where(~F.col("text").startswith("#") & (strip("text") != ""))
    parts = rows.select("pos", F.split("text", "\t").alias("p")).select("pos", F.col("p")[0].alias("config"), F.try_element_at("p", F.lit(2)).alias("out_dir"))
    return numbered(parts, "pos", "_n").select((F.col("_n") + 1).alias("line"), "config", "out_dir")


def step_of(path: Column | str) -> Column:
    """The number at the end of a checkpoint's name, or null."""
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\d+)/?$", 1).try_cast("long")


def epoch_and_batch(path: Column | str, missing_batch: int = 10_000) -> tuple[Column, Column]:
    """Epoch and batch of a name like epoch_3_batch_200; without a batch the epoch's end."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(c, r"epoch_(\d+)", 1).try_cast("long"), F.coalesce(F.regexp_extract(c, r"batch_(\d+)", 1).try_cast("long"), F.lit(missing_batch))


def checkpoints(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """path and step of the paths that end in a step, in order of steps; an error if there are none."""
    listed = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    rows = listed.select("path").withColumn("step", step_of("path")).where("step is not null")
    if rows.isEmpty():
        raise ValueError("no checkpoints")
    return rows.orderBy("step")


def model_folders(files: DataFrame, marks: list[str]) -> DataFrame:
    """The folders among file paths (path) that hold one of the marking files."""
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return rows.groupBy("folder").agg(F.bool_or(F.col("name").isin(*marks)).alias("marked")).where("marked").select("folder")


def fields_of(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer: integers, or the bytes of 32 and 64 bit numbers, texts and messages."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def token_cache(texts: DataFrame, cached: DataFrame, compute: Column) -> DataFrame:
    """texts with key (sha1) and tokens, from the cache where it has them, else computed."""
    keyed = texts.withColumn("key", F.sha1("text"))
    known = keyed.join(cached.select("key", F.col("tokens").alias("_known")), "key", "left")
    return known.withColumn("tokens", F.coalesce("_known", compute)).drop("_known")
