"""Round trips through file formats and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mixture
from ..sources import readers, stores, writers
from ..sources.tables import new_folder as _folder
from ..sources.tables import stored
from ..streaming import packing
from .base import SQL_BARE, bare, table
from .catalog import query


@query(f"WITH {SQL_BARE} SELECT text, count(*) AS n FROM bare GROUP BY text")
def io_text_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "text")
    writers.text(bare(spark, d), path)
    return readers.nonempty_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, text FROM benchmark")
def io_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    writers.csv(table(spark, d, "benchmark"), path, ["item_id", "text"])
    return readers.csv_typed(spark, path, "item_id BIGINT, text STRING")


@query("SELECT conv_id, turn, role, text FROM conversations")
def io_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "json")
    writers.json_rows(table(spark, d, "conversations"), path)
    return readers.json_lines(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def io_routed(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "routed")
    writers.routed(table(spark, d, "documents"), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT count(*) AS n, count(DISTINCT user_id || '|' || event_type) AS n_appended, 0::BIGINT AS n_again FROM (SELECT DISTINCT user_id, event_type FROM events)")
def io_append_new(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "append")
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    first, again = (writers.append_new(rows, path, ["user_id", "event_type"]) for _ in range(2))
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(first).cast("long").alias("n_appended"), F.lit(again).cast("long").alias("n_again"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.from_json("props", "k BIGINT")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


_STREAM = r"""WITH t AS (SELECT lang AS source, doc_id % 8 AS shard, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS token FROM documents),
s AS (SELECT source, count(*) // 256 AS n FROM t GROUP BY source, shard) SELECT source, sum(n)::BIGINT AS n_blocks, CAST(sum(n) * 256 AS BIGINT) AS n_tokens FROM s GROUP BY source HAVING sum(n) > 0"""


@query(_STREAM)
def stream_pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*").select(F.col("lang").alias("source"), F.col("doc_id").alias("pos"), "text")
    got = packing.run_to_end(packing.packed(docs, 256, shards=8), _folder(spark, "blocks"), _folder(spark, "checkpoint"), together=500)
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.size("tokens")).alias("n_tokens"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id")
def stream_poll_files(spark: SparkSession, d: str) -> DataFrame:
    path, checkpoint = _folder(spark, "polled"), _folder(spark, "checkpoint")
    schema = table(spark, d, "events").schema

    def handle(batch: DataFrame, number: int) -> None:
        stores.batch_once(batch.select("event_id", "user_id"), path, number)

    for _ in range(2):  # the second poll finds nothing new
        packing.poll(spark, spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"), checkpoint, handle)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


_U = "CAST('0x' || substr(md5('23|' || event_id), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(
    f"""WITH e AS (SELECT event_id, CASE WHEN {_U} < 0.5 THEN 'en' WHEN {_U} < 0.8 THEN 'fr' ELSE 'de' END AS source FROM events), k AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY event_id) - 1 AS k FROM e),
t AS (SELECT lang AS source, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token FROM documents), n AS (SELECT source, count(*) // 128 AS n FROM t GROUP BY source)
SELECT source, k % n AS source_block, count(*) AS n FROM k JOIN n USING (source) GROUP BY ALL"""
)
def stream_weighted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of a stream draw sources by weight; each takes its source's next block, from the first again after the last."""
    weights = {"en": 5.0, "fr": 3.0, "de": 2.0}
    docs = table(spark, d, "documents").where(F.col("lang").isin(*weights)).select(F.col("lang").alias("source"), F.col("doc_id").alias("pos"), T.words("text").alias("words"))
    blocks = stored(mixture.source_blocks(docs, 128), "source-blocks")
    ticks = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    stream = packing.drawn_items(packing.draws_in_order(ticks, weights, 23, at="event_id"), blocks)
    got = packing.run_to_end(stream.select("source", F.col("at").alias("source_block"), F.size("tokens").alias("n_tokens")), _folder(spark, "draws"), _folder(spark, "checkpoint"))
    return got.where("n_tokens = 128").groupBy("source", "source_block").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH p AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM conversations) SELECT conv_id, turn, count(*) AS n, sum(length(sentence))::BIGINT AS n_chars FROM p GROUP BY ALL""")
def stream_sentences(spark: SparkSession, d: str) -> DataFrame:
    """A stream of texts as a stream of sentences."""
    turns = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parquet*")
    rows = turns.select("conv_id", "turn", F.explode(T.sentences("text")).alias("sentence"))
    got = packing.run_to_end(rows, _folder(spark, "sentences"), _folder(spark, "checkpoint"))
    return got.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


@query("SELECT doc_id % 4 AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def stream_until_producer_ends(spark: SparkSession, d: str) -> DataFrame:
    """Polls while a producer writes part after part; each row is handled once, the last ones after the producer has ended."""
    source, out, checkpoint = _folder(spark, "produced"), _folder(spark, "handled"), _folder(spark, "checkpoint")
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("part"))
    made = iter(range(4))

    def produce() -> bool:
        k = next(made, None)
        if k is not None:
            docs.where(F.col("part") == k).write.mode("append").parquet(source)
        return k is None or k == 3

    packing.poll_until(spark, lambda: spark.readStream.schema(docs.schema).parquet(source), checkpoint, lambda batch, number: stores.batch_once(batch, out, number), produce)
    return spark.read.parquet(out).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(r"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\s+', '|', 'g'), '|'), lambda x: x), lambda x: x <> '')[1] AS first_part, len(list_filter(string_split(regexp_replace(text, '\s+', '|', 'g'), '|'), lambda x: x <> ''))::BIGINT AS n_parts FROM documents")
def split_multi_values(spark: SparkSession, d: str) -> DataFrame:
    parts = T.split_multi(F.regexp_replace("text", r"\s+", "|"))
    return table(spark, d, "documents").select("doc_id", F.try_element_at(parts, F.lit(1)).alias("first_part"), F.size(parts).cast("long").alias("n_parts"))
