"""Writers of corpora, result tables and configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored


def text(df: DataFrame, path: str, column: str = "text", order: str | None = None, mode: str = "error") -> None:
    """One line per row, in order of a column if one is named."""
    (df.orderBy(order) if order else df).select(column).write.mode(mode).text(path)


def parallel_text(df: DataFrame, paths: dict[str, str], order: str, mode: str = "error") -> None:
    """Columns to files of their own whose lines belong together."""
    rows = df.orderBy(order)
    for column, path in paths.items():
        text(rows, path, column, order, mode)


def csv(df: DataFrame, path: str, fields: Sequence[str], mode: str = "error") -> None:
    """The fields, in this order, with a header; other columns are left out. Null and the empty text stay apart."""
    df.select(*fields).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue='""', nullValue="")


def json_rows(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def routed(df: DataFrame, path: str, by: str, mode: str = "error") -> None:
    """One folder for each value of a column, in one pass."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def chunks(df: DataFrame, path: str, rows: int | None = None, row_bytes: int = 4 * 1024, size: int = 64 << 20, mode: str = "error") -> None:
    """Parquet files of at most so many rows, or of as many blocks of row_bytes as make size bytes (64 MB)."""
    rows = rows or max(1, size // row_bytes)
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose keys the table at path lacks, and says how many; doing it twice changes nothing. The new rows are settled in a stored table first."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    rows = df.dropDuplicates(list(keys))
    if there:
        old = spark.read.schema(df.schema).parquet(path).select(*keys)
        rows = rows.join(old, list(keys), "left_anti").select(df.columns)
    rows = stored(rows, "new-rows")
    n = rows.count()
    if n or not there:
        rows.write.mode("append").parquet(path)
    return n


def yaml_text(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """rows with yaml, the fields as a YAML document; structs, arrays and maps stand in flow style, nested as they are."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("struct", "array", "map")}
    text = lambda f: F.to_json(f, {"ignoreNullFields": "false"}) if f in nested else F.col(f).cast("string")
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(text(f), F.lit("null"))) for f in fields]
    return rows.withColumn("yaml", F.concat(F.concat_ws("\n", *lines), F.lit("\n")))


def manifest(rows: DataFrame, path: str, config: str = "config", out_dir: str = "out_dir", order: str = "exp", mode: str = "error") -> None:
    """A tab-separated manifest with its header line, in order."""
    header = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_at"), F.lit(f"#{config}\t{out_dir}").alias("text"))
    body = rows.select(F.col(order).cast("long").alias("_at"), F.concat_ws("\t", config, out_dir).alias("text"))
    header.unionByName(body).orderBy("_at").coalesce(1).select("text").write.mode(mode).text(path)  # a line per run


def arrays(df: DataFrame, path: str, mode: str = "error") -> None:
    """Summary arrays and scalars as one Parquet table."""
    df.write.mode(mode).parquet(path)
