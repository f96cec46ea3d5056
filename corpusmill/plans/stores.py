"""Kept tables, chunks, listings and table functions over the driver's tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.order import numbered
from ..sources import files, readers, stores, tablefunctions
from ..sources.tables import new_folder
from .base import table
from .catalog import query


@query(
    """WITH old AS (SELECT event_type AS run, user_id AS step, max(value) AS value FROM events GROUP BY ALL), new AS (SELECT run, step + 40 AS step, value + 1 AS value FROM old WHERE run IN ('click', 'error')),
n AS (SELECT count(DISTINCT run) AS runs, count(*) FILTER (WHERE run IN ('click', 'error')) > 0 AS any FROM old)
SELECT coalesce(new.run, old.run) AS run, coalesce(new.step, old.step) AS step, round(coalesce(new.value, old.value), 4) AS value, (SELECT count(DISTINCT run) FROM new) AS n_folders FROM old FULL JOIN new ON old.run = new.run AND old.step = new.step"""
)
def summary_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Summary rows by run and step: two runs are evaluated again at later steps, twice; rows there before are replaced and only those runs' folders written."""
    path = new_folder(spark, "summary")
    old = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("step")).agg(F.max("value").alias("value"))
    stores.upsert(old, path, ["run", "step"], "run")
    new = old.where(F.col("run").isin("click", "error")).select("run", (F.col("step") + 40).alias("step"), (F.col("value") + 1).alias("value"))
    n = [stores.upsert(new, path, ["run", "step"], "run") for _ in range(2)][-1]
    return spark.read.schema(old.schema).parquet(path).select("run", "step", F.round("value", 4).alias("value"), F.lit(n).cast("long").alias("n_folders"))


@query(
    r"""SELECT conv_id, turn, sha1(text) AS key, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS n_tokens, text IN (SELECT text FROM conversations WHERE conv_id % 2 = 0) AS from_cache, true AS all_there
FROM conversations"""
)
def cache_filled_on_miss(spark: SparkSession, d: str) -> DataFrame:
    """Half of the conversations fill the cache, all ask it, and after that nothing is missing."""
    path, turns = new_folder(spark, "cache"), table(spark, d, "conversations").select("conv_id", "turn", "text")
    stores.cached(turns.where("conv_id % 2 = 0"), path, T.words("text"))
    got = stores.cached(turns, path, T.words("text"))
    again = stores.cached(turns, path, T.words("text")).agg(F.bool_and("from_cache").alias("all_there"))
    rows = got.select("conv_id", "turn", "key", F.size("value").cast("long").alias("n_tokens"), "from_cache")
    return rows.join(F.broadcast(again))  # one row


_CHUNK = 40_000


@query(
    f"""WITH r AS (SELECT doc_id, octet_length(encode(text)) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM documents) SELECT row_no, doc_id, n AS n_bytes, true AS bounded, true AS indexed FROM r WHERE row_no % 7 = 3"""
)
def chunks_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Files bounded in bytes for texts of any length, read by row number through their index."""
    path = new_folder(spark, "byte-chunks")
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = stores.byte_chunks(docs, path, "doc_id", _CHUNK, F.octet_length("text"))
    held = stores.rows_there(spark, path).groupBy("chunk", "file").agg(F.sum(F.octet_length("text") + stores.ROW).alias("n"), F.count(F.lit(1)).alias("rows"))
    bounds = held.agg(F.bool_and((F.col("n") <= _CHUNK) | (F.col("rows") == 1)).alias("bounded"), F.count(F.lit(1)).alias("_files"))
    same = index.agg(F.count(F.lit(1)).alias("_chunks"))
    asked = spark.range(docs.count()).where("id % 7 = 3").select(F.col("id").alias("row_no"))
    got = stores.rows_at(asked, path).select("row_no", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return got.join(F.broadcast(bounds)).join(F.broadcast(same)).select("row_no", "doc_id", "n_bytes", "bounded", (F.col("_files") == F.col("_chunks")).alias("indexed"))


def _tree(spark: SparkSession, d: str) -> str:
    """A folder for each model of the documents' sources, checkpoints in it, a configuration in every third."""
    root = new_folder(spark, "models")
    rows = table(spark, d, "documents").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("checkpoint-"), (F.col("doc_id") % 40 * 50).cast("string"))).alias("folder"), (F.col("doc_id") % 40 % 3 == 0).alias("marked"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for folder, marked in zip(f["folder"], f["marked"], strict=True):
                system, inside = files.opened(f"{root}/{folder}")
                system.create_dir(inside, recursive=True)
                for name in ["weights.bin", *(["config.json"] if marked else [])]:
                    with system.open_output_stream(f"{inside}/{name}") as out:
                        out.write(json.dumps({"folder": folder}).encode())
            yield f[["folder"]].head(0)

    rows.distinct().mapInPandas(write, "folder string").count()
    return root


_FOLDERS = "f AS (SELECT DISTINCT coalesce(source, 'none') AS run, doc_id % 40 * 50 AS step, doc_id % 40 % 3 = 0 AS marked FROM documents)"


@query(f"WITH {_FOLDERS} SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS place, n FROM f JOIN (SELECT run, count(*) AS n FROM f GROUP BY run) USING (run)")
def checkpoint_tree(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoints of all runs of a folder tree, listed by tasks, in order of their steps."""
    root = _tree(spark, d)
    folders = files.listed(spark, root).where(F.col("folder") & F.col("path").rlike("/checkpoint-[0-9]+$"))
    rows = readers.checkpoints(spark, folders.select("path")).withColumn("run", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    return numbered(rows, "step", "place", by="run", total="n").select("run", "step", "place", "n")


@query(f"WITH {_FOLDERS} SELECT run || '/checkpoint-' || step AS folder FROM f WHERE marked")
def model_folder_tree(spark: SparkSession, d: str) -> DataFrame:
    """The folders of a tree that hold a marking file."""
    root = _tree(spark, d)
    found = readers.model_folders(files.listed(spark, root).where("not folder"), ["config.json", "lit_model.pth"])
    return found.select(F.regexp_extract("folder", "([^/]+/[^/]+)$", 1).alias("folder"))


@query(
    r"""WITH l AS (SELECT doc_id, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT doc_id AS key, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS line_no, line, len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> ''))::INT AS n_words FROM l WHERE line <> ''"""
)
def table_function_lines(spark: SparkSession, d: str) -> DataFrame:
    """The generator of lines, called from SQL."""
    tablefunctions.register(spark)
    return spark.sql("SELECT * FROM corpus_lines(TABLE(SELECT doc_id AS key, text FROM {docs}) PARTITION BY key ORDER BY key)", docs=table(spark, d, "documents"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations)),
g AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS g FROM w) SELECT conv_id AS key, (g // 32)::INT AS block_no, count(*) AS n, string_agg(word, ' ' ORDER BY g) AS words FROM g GROUP BY ALL"""
)
def table_function_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The words of each conversation in blocks, turn after turn, by a generator that keeps its rest between rows."""
    tablefunctions.register(spark)
    got = spark.sql("SELECT * FROM corpus_blocks(TABLE(SELECT conv_id AS key, turn, text FROM {turns}) PARTITION BY key ORDER BY (turn), 32)", turns=table(spark, d, "conversations"))
    return got.select("key", "block_no", F.size("tokens").cast("long").alias("n"), F.concat_ws(" ", "tokens").alias("words"))
