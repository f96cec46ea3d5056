"""Streams of packed mixtures and of generated rows over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.order import numbered, running_sum
from ..sources import generator
from ..sources.tables import new_folder, stored
from ..streaming import mixture, packing
from .base import table
from .catalog import query

_WEIGHTS, _SIZE, _SEED, _SHARDS, _PARTS = {"en": 5.0, "fr": 3.0, "de": 2.0}, 128, 31, 4, 3
_U = f"CAST('0x' || substr(md5('{_SEED}|' || b), 1, 13) AS BIGINT) / 4503599627370496.0"
_MIXED = rf"""w AS (SELECT lang AS source, doc_id % {_SHARDS} AS shard, doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE lang IN ('en', 'fr', 'de')),
t AS (SELECT source, shard, token, row_number() OVER (PARTITION BY source, shard ORDER BY doc_id, i) - 1 AS g FROM (SELECT source, shard, doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM w)),
s AS (SELECT source, (g // {_SIZE}) * {_SHARDS} + shard AS source_block, string_agg(token, ' ' ORDER BY g) AS words, count(*) AS n FROM t GROUP BY source, shard, g // {_SIZE}),
k AS (SELECT source, b AS block_no, row_number() OVER (PARTITION BY source ORDER BY b) - 1 AS k FROM
  (SELECT b, CASE WHEN {_U} < 0.5 THEN 'en' WHEN {_U} < 0.8 THEN 'fr' ELSE 'de' END AS source FROM (SELECT unnest(range({{draws}})) AS b)))"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("source"), F.lit(None).cast("int").alias("shard"), F.col("doc_id").alias("pos"), "text", F.lit(False).alias("ended"))
    return docs.where(F.col("source").isin(*_WEIGHTS))


def _mixed(spark: SparkSession, d: str, samples: int | None = None) -> DataFrame:
    return _in_parts(spark, d, lambda stream: mixture.packed_mixture(stream, _WEIGHTS, _SIZE, _SEED, _SHARDS, samples, together=16), _SHARDS)


#: Bytes of text of a part at most, but for its last text: a trigger's documents of a shard are in one task.
_PART_BYTES = 512_000_000


def _starts(docs: DataFrame, size: int = _PART_BYTES) -> list[int]:
    """The pos that each part of docs starts with: some parts of alike bytes of text, none of more than size but for its last text."""
    sizes = docs.where("pos is not null").groupBy("pos").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("_n"))
    placed = running_sum(sizes, "pos", "_n", "_before", total="_all", settled=True)
    part = F.floor(F.col("_before") / F.greatest(F.lit(1), F.least(F.lit(size), F.ceil(F.col("_all") / _PARTS))))
    return sorted(r[0] for r in placed.groupBy(part).agg(F.min("pos")).select("min(pos)").collect())


def _in_parts(spark: SparkSession, d: str, packed: Callable[[DataFrame], DataFrame], shards: int) -> DataFrame:
    """The blocks of documents that come in some parts, each a run of a stream that is stopped after it, then the end."""
    folder, out, checkpoint = new_folder(spark, "arriving"), new_folder(spark, "mixture"), new_folder(spark, "checkpoint")
    docs = _documents(spark, d)
    starts = _starts(docs)
    blocks = None
    for part in range(len(starts) + 1):
        if part < len(starts):
            rows = docs.where(F.col("pos") >= starts[part])
            rows = rows if part + 1 == len(starts) else rows.where(F.col("pos") < starts[part + 1])
        else:
            rows = mixture.ends(spark, list(_WEIGHTS), shards)
        rows.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(docs.schema).parquet(folder)
        blocks = mixture.run(packed(stream), out, checkpoint)
    return blocks


@query("WITH " + _MIXED.format(draws="(SELECT count(*) * 40 FROM documents)") + ", a AS (SELECT max(k) AS most FROM k) SELECT block_no, source, source_block, n AS n_tokens, sha256(words) AS words FROM s JOIN k USING (source) WHERE k = source_block")
def stream_packed_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents in a block at its place in the mixture, over restarts, the last blocks of the shards shorter."""
    got = _mixed(spark, d)
    return got.select("block_no", "source", "source_block", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", "tokens"), 256).alias("words"))


@query(
    "WITH " + _MIXED.format(draws="(SELECT count(*) FROM documents)")
    + f""", f AS (SELECT source, source_block, words, row_number() OVER (PARTITION BY source ORDER BY source_block) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM s JOIN k USING (source) WHERE k = source_block AND n = {_SIZE})
SELECT block_no, source, source_block, sha256(words) AS words FROM k JOIN f USING (source) WHERE place = k % size"""
)
def stream_mixture_to_cap(spark: SparkSession, d: str) -> DataFrame:
    """As many draws as there are documents: the stream stops at the cap, sources that run out before start again."""
    samples = table(spark, d, "documents").count()
    got = mixture.filled(stored(_mixed(spark, d, samples), "mixture-blocks"), _WEIGHTS, samples, _SEED, _SIZE)
    return got.select("block_no", "source", "source_block", F.sha2(F.concat_ws(" ", "tokens"), 256).alias("words"))


_SHARED = 3
_US = f"CAST('0x' || substr(md5('{_SEED}-' || shard || '|' || b), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(
    rf"""WITH w AS (SELECT lang AS source, doc_id % {_SHARED} AS shard, doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws, row_number() OVER (PARTITION BY lang, doc_id % {_SHARED} ORDER BY doc_id) - 1 AS k FROM documents WHERE lang IN ('en', 'fr', 'de') AND text IS NOT NULL),
b AS (SELECT shard, b, CASE WHEN {_US} < 0.5 THEN 'en' WHEN {_US} < 0.8 THEN 'fr' ELSE 'de' END AS source FROM (SELECT unnest(range({_SHARED})) AS shard), (SELECT unnest(range((SELECT count(*) * 20 FROM documents))) AS b)),
o AS (SELECT w.shard, b, ws FROM w JOIN (SELECT *, row_number() OVER (PARTITION BY shard, source ORDER BY b) - 1 AS k FROM b) d USING (shard, source, k)),
t AS (SELECT shard, token, row_number() OVER (PARTITION BY shard ORDER BY b, i) - 1 AS g FROM (SELECT shard, b, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM o))
SELECT shard::INT AS shard, g // {_SIZE} AS block_no, count(*) AS n_tokens, sha256(string_agg(token, ' ' ORDER BY g)) AS words FROM t GROUP BY shard, g // {_SIZE}"""
)
def stream_shared_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Documents drawn by weight through one buffer for all sources, over restarts and to the end."""
    got = _in_parts(spark, d, lambda stream: mixture.packed_shared(stream, _WEIGHTS, _SIZE, _SEED, _SHARED, together=16), _SHARED)
    return got.select("shard", "block_no", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", "tokens"), 256).alias("words"))


_WORDS = 60


@query(
    f"""WITH a AS (SELECT source AS w, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
b AS (SELECT role AS w, row_number() OVER (ORDER BY role) - 1 AS i FROM (SELECT DISTINCT role FROM conversations)),
c AS (SELECT word AS w, row_number() OVER (ORDER BY n DESC, word) - 1 AS i FROM (SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word FROM benchmark) GROUP BY word ORDER BY n DESC, word LIMIT {_WORDS}))
SELECT (a.i * (SELECT count(*) FROM b) + b.i) * (SELECT count(*) FROM c) + c.i AS number, a.w || ' ' || b.w || ' ' || c.w AS sentence, 3 AS n_batches FROM a, b, c"""
)
def resumed_generation(spark: SparkSession, d: str) -> DataFrame:
    """All sentences that three lists of words from the tables make, by a generator that is stopped after each third and goes on."""
    placed = lambda rows, k, *order: numbered(rows.withColumn("_all", F.lit(0)), "_all", "at", ties=order).select(F.lit(k).alias("slot"), "at", "word")
    distinct = lambda name, column: table(spark, d, name).where(F.col(column).isNotNull()).select(F.col(column).alias("word")).distinct()
    words = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("word")).groupBy("word").agg((-F.count(F.lit(1))).alias("_n")).orderBy("_n", "word").limit(_WORDS)
    slots = stored(placed(distinct("documents", "source"), 0, "word").union(placed(distinct("conversations", "role"), 1, "word")).union(placed(words, 2, "_n", "word")), "slots")
    out, checkpoint = new_folder(spark, "generated"), new_folder(spark, "checkpoint")
    rows = generator.size(slots)
    before, batches = -1, 0
    while True:
        stream = generator.sentences(generator.numbers(spark, rows, per_batch=-(-rows // 3)), slots)
        got = packing.run_to_end(stream, out, checkpoint)
        n = got.count()
        if n == before:
            return got.withColumn("n_batches", F.lit(batches))
        before, batches = n, batches + 1
