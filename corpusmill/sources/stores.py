"""Tables that are kept up to date: keyed upsert, a cache that fills itself, batches written once, and chunks of bounded bytes with an index."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.order import filled, running_sum
from . import files
from .tables import stored

#: Bytes that a row takes besides its own: its entry in a file.
ROW = 8
#: The name of a chunk's file, and an entry of the index when it is written.
_FILE, _ENTRY = "part.parquet", pa.schema([("chunk", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64())])
#: Bytes of rows read that leave a task together.
_TOGETHER = 1 << 20


def _qualified(spark: SparkSession, path: str) -> str:
    """path with the store that Spark takes it to be in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _overwrite(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the folders of the values of by that rows have; all others stay."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(df: DataFrame, path: str, keys: Sequence[str], by: str, latest: str | None = None) -> int:
    """Puts the rows of df into the table at path in place of those with the same keys; says how many folders it wrote.

    by, a column that the keys determine and that is never null (the run, or bucket_of() the keys), names the folders; only those that df touches are read
    and written, whatever else the table holds. Of rows of df with the same keys the one of the largest latest counts, without it any one; null keys are equal to each other. Doing it
    twice is doing it once. What is written is settled in a stored table first, so a run that is cut off can be repeated.
    """
    spark, whole = df.sparkSession, F.struct(*df.columns)
    best = F.max_by(whole, latest) if latest else F.first(whole)
    new = stored(df.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(best.alias("_row")).select("_row.*"), "upsert-new")
    touched = [v for (v,) in new.select(by).distinct().collect()]  # the folders of this batch
    if None in touched:
        raise ValueError(f"{by} names a folder and can't be null")
    if not touched:
        return 0
    rows = new
    if _there(spark, path):
        old = spark.read.schema(StructType([*(f for f in df.schema if f.name != by), StructField(by, df.schema[by].dataType)])).parquet(path).where(F.col(by).isin(*touched))
        mine = new.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
        kept = old.join(mine, [old[k].eqNullSafe(mine[f"_new_{k}"]) for k in keys], "left_anti")
        rows = stored(new.unionByName(kept), "upsert-whole")
    _overwrite(rows, path, by)
    return len(touched)


def bucket_of(keys: Sequence[str], buckets: int = 64) -> Column:
    """A number under buckets from the keys, to name folders by."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def cached(texts: DataFrame, path: str, compute: Column, text: str = "text", buckets: int = 64) -> DataFrame:
    """texts with key (sha1 of the text), value and from_cache; what the cache at path lacks is computed once for each different text and put into it.

    compute is an expression over text. A null text has a null key and value and isn't kept. Only the folders of new keys are written.
    """
    spark = texts.sparkSession
    keyed = stored(texts.withColumn("key", F.sha1(F.col(text))), "cache-asked")
    place = bucket_of(["key"], buckets)
    asked = keyed.where("key is not null").select("key", F.col(text)).dropDuplicates(["key"])
    schema = StructType([StructField("key", keyed.schema["key"].dataType), StructField("value", texts.select(compute.alias("value")).schema["value"].dataType), StructField("bucket", IntegerType())])
    known = spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)
    known = stored(known.join(asked.select("key"), "key", "left_semi"), "cache-known")
    fresh = stored(asked.join(known.select("key"), "key", "left_anti").select("key", compute.alias("value"), place.alias("bucket")), "cache-fresh")
    upsert(fresh, path, ["key"], "bucket")
    both = known.select("key", "value", F.lit(True).alias("from_cache")).unionByName(fresh.select("key", "value", F.lit(False).alias("from_cache")))
    return keyed.join(both, "key", "left")


def batch_once(batch: DataFrame, path: str, number: int) -> None:
    """Writes a batch of a stream into a folder of its own, named by its number: a batch that is handed over again replaces itself, and nothing else is read."""
    _overwrite(batch.withColumn("batch", F.lit(number).cast("long")), path, "batch")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _written(root: str, columns: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes columns of rows in order of their chunk into a file for each chunk and gives chunk, rows and bytes. A file gets its name when it is whole, so a task that comes again replaces it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = files.opened(root)
        at, held = None, []

        def put() -> dict:
            table = pa.Table.from_batches(held)
            folder = f"{top}/chunk={at}"
            system.create_dir(folder, recursive=True)
            name = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(name) as out:
                pq.write_table(table.select(columns), out, use_dictionary=False, write_statistics=["row_no"], store_schema=False)
            system.move(name, f"{folder}/{_FILE}")
            held.clear()
            return {"chunk": at, "rows": table.num_rows, "bytes": pc.sum(table["_bytes"]).as_py()}

        for batch in batches:
            done, chunks = [], batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)] if len(chunks) else []
            for start, end in pairwise(cuts):
                if held and chunks[start] != at:
                    done.append(put())
                at = int(chunks[start])
                held.append(batch.slice(start, end - start))
            if done:
                yield pa.RecordBatch.from_pylist(done, _ENTRY)
        if held:
            yield pa.RecordBatch.from_pylist([put()], _ENTRY)

    return write


def byte_chunks(df: DataFrame, path: str, order: str, size: int, row_bytes: Column) -> DataFrame:
    """Writes df in order to files of at most size bytes and gives their index: chunk, first_row, rows and bytes.

    row_bytes are the bytes of a row (null counts as none); each takes ROW more. Only the file of a single row can be larger than size. Files are filled one after the other in each
    range of order, so they are some size bytes each but the last ones of the ranges. Below path there are rows, a folder for each chunk with row_no
    beside the columns, index, and columns, an empty table like rows. Equal values of order stand in any order.

    Tasks write and open the files themselves, by files.opened(): Spark's writer and its listing of folders take many times longer for files this small.
    """
    spark = df.sparkSession
    sized = df.withColumn("_bytes", F.coalesce(row_bytes.cast("long"), F.lit(0).cast("long")) + ROW)
    placed = filled(sized, order, "_bytes", size, "chunk", "row_no", settled=True)
    columns = ["row_no", *df.columns]
    dealt = placed.select("chunk", "_bytes", *columns).repartition(_parts(spark), "chunk").sortWithinPartitions("chunk", "row_no")
    written = dealt.mapInArrow(_written(_qualified(spark, f"{path}/rows"), columns), "chunk long, rows long, bytes long")
    index = stored(running_sum(written, "chunk", "rows", "first_row").select("chunk", "first_row", "rows", "bytes"), "chunk-index")
    placed.select(*columns).limit(0).write.parquet(f"{path}/columns")
    index.coalesce(1).write.parquet(f"{path}/index")  # a row for each file
    return index


def _opened(asked: DataFrame, path: str) -> DataFrame:
    """The rows of all files in the folders of asked (chunk), with chunk and file; of row_nos, where it isn't null, only those. Tasks are those of asked, which should be dealt out."""
    spark = asked.sparkSession
    schema = spark.read.parquet(f"{path}/columns").schema
    root, columns = _qualified(spark, f"{path}/rows"), schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = files.opened(root)
        held, size = [], 0
        for batch in batches:
            for chunk, numbers in zip(batch.column("chunk").to_pylist(), batch.column("row_nos"), strict=True):
                for info in system.get_file_info(pyarrow.fs.FileSelector(f"{top}/chunk={chunk}")):
                    if info.base_name[0] in "._":
                        continue
                    with system.open_input_file(info.path) as file:
                        table = pq.ParquetFile(file).read(use_threads=False).select(columns)
                    if numbers.is_valid:
                        table = table.filter(pc.is_in(table["row_no"], value_set=numbers.values))
                    n = table.num_rows
                    table = table.append_column("chunk", pa.array([chunk] * n, pa.int64())).append_column("file", pa.array([f"{root}/chunk={chunk}/{info.base_name}"] * n, pa.string()))
                    held.append(table)
                    size += table.nbytes
                    if size > _TOGETHER:
                        yield from pa.concat_tables(held).combine_chunks().to_batches()
                        held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return asked.select("chunk", "row_nos").mapInArrow(read, StructType([*schema, StructField("chunk", LongType()), StructField("file", StringType())]))


def rows_there(spark: SparkSession, path: str) -> DataFrame:
    """All rows of byte_chunks() with chunk and file, of the folders and files that are there, whatever the index says."""
    root = _qualified(spark, f"{path}/rows")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, top = files.opened(root)
            found = system.get_file_info(pyarrow.fs.FileSelector(top, allow_not_found=True))
            names = [i.base_name.removeprefix("chunk=") for i in found if i.base_name.startswith("chunk=")]
            for at in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000]).cast(pa.int64())], ["chunk"])

    folders = spark.range(1).coalesce(1).mapInArrow(look, "chunk long")  # one folder's names
    return _opened(folders.repartition(_parts(spark), "chunk").withColumn("row_nos", F.lit(None).cast("array<long>")), path)


def rows_at(numbers: DataFrame, path: str) -> DataFrame:
    """The rows of byte_chunks() of the asked numbers (row_no, each once); numbers beyond the table give nothing. The index says which chunks are opened."""
    spark = numbers.sparkSession
    index = spark.read.parquet(f"{path}/index")
    # Numbers and first rows in one order: how many first rows lie up to a number says which chunk it is in.
    starts = index.select(F.col("first_row").alias("_at"), F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("_start"), F.lit(None).cast("long").alias("row_no"))
    asked = numbers.select(F.col("row_no").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_start"), F.col("row_no").cast("long").alias("row_no"))
    counted = running_sum(starts.unionByName(asked), "_at", "_start", "_passed", ties=("_kind",))
    listed = running_sum(index.withColumn("_one", F.lit(1).cast("long")), "chunk", "_one", "_place")
    wanted = stored(counted.where("_kind = 1").join(listed, F.col("_passed") - 1 == F.col("_place")).select("row_no", "chunk"), "chunks-asked")
    dealt = wanted.repartition(_parts(spark), "chunk")  # few bytes, and much work: their number of partitions stays
    return _opened(dealt.groupBy("chunk").agg(F.collect_list("row_no").alias("row_nos")), path).drop("file")  # size / ROW numbers at most
