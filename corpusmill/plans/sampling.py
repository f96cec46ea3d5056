"""Samples, splits, frequency changes and mixtures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, mixture, sampling, tokens
from .base import SQL_BARE, SQL_DOC_WORDS, bare, doc_words, number, shown, table
from .catalog import query


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 200")
def sample_n(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(table(spark, d, "documents").select("doc_id", "lang"), 200, "doc_id", 7)


@query(
    """WITH a AS (SELECT doc_id, quality FROM labels WHERE toxic = 1 ORDER BY md5('7|' || doc_id), doc_id LIMIT 100),
b AS (SELECT doc_id, quality FROM labels WHERE toxic = 0 ORDER BY md5('7|' || doc_id), doc_id LIMIT (SELECT 200 - count(*) FROM a))
SELECT *, 1 AS first FROM a UNION ALL SELECT *, 0 AS first FROM b"""
)
def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.stratified_halves(table(spark, d, "labels"), F.col("toxic") == 1, 200, "doc_id", 7)
    return rows.select("doc_id", "quality", F.col("toxic").alias("first"))


@query(
    """WITH k AS (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY md5('7|' || l_orderkey), l_orderkey LIMIT 300),
n AS (SELECT l_orderkey, CAST(row_number() OVER (ORDER BY l_orderkey) - 1 AS BIGINT) AS new_id FROM k)
SELECT new_id, l_orderkey, l_linenumber FROM lineitem JOIN n USING (l_orderkey)"""
)
def sample_clusters_reid(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.clusters(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 300, 7)
    return number(rows, "new_id").select("new_id", "l_orderkey", "l_linenumber")


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS k FROM documents)
SELECT doc_id, CASE WHEN k < 50 THEN 'test' ELSE 'final' END AS split FROM r WHERE k < 150"""
)
def split_test_final(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_test_final(table(spark, d, "documents").select("doc_id"), 50, 100, "doc_id", 42)


@query(
    """WITH r AS (SELECT l_orderkey, row_number() OVER (ORDER BY md5('42|' || l_orderkey), l_orderkey) - 1 AS k FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
n AS (SELECT floor(count(*) * 0.8) AS cut FROM r)
SELECT split, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_groups, sum(l_linenumber)::BIGINT AS lines FROM lineitem JOIN (SELECT l_orderkey, CASE WHEN k < cut THEN 'train' ELSE 'eval' END AS split FROM r, n) USING (l_orderkey) GROUP BY split"""
)
def split_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.split_groups(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 0.8, 42)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_groups"), F.sum("l_linenumber").alias("lines"))


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9|' || doc_id), doc_id) - 1 AS k FROM documents)
SELECT doc_id, CASE WHEN k < 30 THEN 'long' ELSE 'short' END AS pick FROM r WHERE k < 80"""
)
def disjoint_picks(spark: SparkSession, d: str) -> DataFrame:
    return sampling.disjoint_picks(table(spark, d, "documents").select("doc_id"), {"long": 30, "short": 50}, "doc_id", 9)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) - 1 AS BIGINT) AS place FROM documents")
def shuffle_all(spark: SparkSession, d: str) -> DataFrame:
    return number(sampling.ranked(table(spark, d, "documents").select("doc_id"), "doc_id", 3, "place"), "place")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['is here', 'is old', 'matters'][CAST('0x' || substr(md5('5|' || doc_id), 1, 8) AS BIGINT) % 3 + 1]
  ELSE ['are here', 'are old'][CAST('0x' || substr(md5('5|' || doc_id), 1, 8) AS BIGINT) % 2 + 1] END AS tail FROM documents"""
)
def choose_by_flag(spark: SparkSession, d: str) -> DataFrame:
    even, odd = (sampling.choose(pool, "doc_id", 5) for pool in (["is here", "is old", "matters"], ["are here", "are old"]))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd).alias("tail"))


_PARTS = (
    f"WITH {SQL_BARE}, base AS (SELECT pos FROM bare WHERE doc_id % 2 = 0), rest AS (SELECT pos, text FROM bare WHERE doc_id % 2 = 1), "
    "one AS (SELECT pos FROM rest WHERE contains(text, 'that')), two AS (SELECT pos FROM rest WHERE NOT contains(text, 'that') AND contains(text, 'who')), "
    "fill AS (SELECT pos FROM rest WHERE NOT contains(text, 'that') AND NOT contains(text, 'who'))"
)


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = bare(spark, d)
    that, who = F.contains("text", F.lit("that")), F.contains("text", F.lit("who"))
    odd = rows.where("doc_id % 2 = 1")
    return tuple(x.select("pos") for x in (rows.where("doc_id % 2 = 0"), odd.where(that), odd.where(~that & who), odd.where(~that & ~who)))


def _r(name: str) -> str:
    return f"(SELECT pos, row_number() OVER (ORDER BY md5('11|' || pos), pos) - 1 AS k FROM {name})"


@query(
    _PARTS
    + f""", q AS (SELECT greatest(0, least(CAST(round_even((0.3 - 0.2) * (SELECT count(*) FROM base) + 0.3 * 400, 0) AS BIGINT), (SELECT count(*) FROM one), 400)) AS k)
SELECT CAST(pos AS VARCHAR) AS pos, origin FROM (SELECT pos, 'base' AS origin FROM base UNION ALL SELECT r.pos, 'target' FROM {_r("one")} r, q WHERE r.k < q.k UNION ALL SELECT r.pos, 'filler' FROM {_r("fill")} r, q WHERE r.k < 400 - q.k)"""
)
def augment_additive(spark: SparkSession, d: str) -> DataFrame:
    base, one, _, fill = _parts(spark, d)
    return shown(sampling.augment(base, one, fill, 400, 0.2, 0.3, "pos", 11))


@query(
    _PARTS
    + f""", n AS (SELECT count(*) AS n FROM base), q AS (SELECT n, CAST(trunc(CAST(n AS DOUBLE) * (CAST(0.22 AS DOUBLE) - CAST(0.2 AS DOUBLE)) / (1 - CAST(0.2 AS DOUBLE))) AS BIGINT) AS a FROM n)
SELECT CAST(pos AS VARCHAR) AS pos, origin FROM (SELECT r.pos, 'base' AS origin FROM {_r("base")} r, q WHERE r.k < n - a UNION ALL SELECT r.pos, 'target' FROM {_r("one")} r, q WHERE r.k < a)"""
)
def replace_exact_n(spark: SparkSession, d: str) -> DataFrame:
    base, one, _, _ = _parts(spark, d)
    return shown(sampling.replace_exact(base, one, 0.2, 0.22, "pos", 11))


def _two(t1: float, t2: float, columns: str = "") -> str:
    x = "CAST({} AS DOUBLE)".format
    k1 = f"CAST(trunc((1 - {x(0.07)}) * n * {x(t1)} / (1 - {x(0.07)} - {x(0.07)} * {x(0.2)})) AS BIGINT)"
    k2 = f"CAST(trunc((1 - {x(0.2)}) * n * {x(t2)} / (1 - {x(0.2)} - {x(0.07)} * {x(0.2)})) AS BIGINT)"
    q = f"(SELECT n, least({k1}, (SELECT count(*) FROM one)) AS k1, least({k2}, (SELECT count(*) FROM two)) AS k2 FROM n)"
    return (
        f"SELECT r.pos, 'base' AS origin{columns} FROM {_r('base')} r, {q} q WHERE r.k < n - k1 - k2 UNION ALL SELECT r.pos, 'first'{columns} FROM {_r('one')} r, {q} q WHERE r.k < k1 "
        f"UNION ALL SELECT r.pos, 'second'{columns} FROM {_r('two')} r, {q} q WHERE r.k < k2"
    )


@query(_PARTS + ", n AS (SELECT count(*) AS n FROM base) SELECT CAST(pos AS VARCHAR) AS pos, origin FROM (" + _two(0.05, 0.02) + ")")
def replace_two_structures(spark: SparkSession, d: str) -> DataFrame:
    base, one, two, _ = _parts(spark, d)
    return shown(sampling.replace_two(base, one, two, (0.2, 0.07), (0.05, 0.02), "pos", 11))


_GOALS = [(0.02, 0.01), (0.05, 0.01), (0.02, 0.03)]


@query(
    _PARTS
    + ", n AS (SELECT count(*) AS n FROM base) SELECT dataset, origin, count(*) AS n, CAST(min(pos) AS VARCHAR) AS least, CAST(max(pos) AS VARCHAR) AS most FROM ("
    + " UNION ALL ".join(_two(a, b, f", 'rc_{round(a * 10000):04d}_q_{round(b * 10000):04d}' AS dataset") for a, b in _GOALS)
    + ") GROUP BY dataset, origin"
)
def frequency_grid(spark: SparkSession, d: str) -> DataFrame:
    base, one, two, _ = _parts(spark, d)
    rows = sampling.frequency_grid(base, one, two, (0.2, 0.07), _GOALS, "pos", 11)
    return shown(rows.groupBy("dataset", "origin").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("least"), F.max("pos").alias("most")), "least", "most")


@query(
    """WITH RECURSIVE c AS (SELECT n AS number, CAST('0x' || substr(md5('a|' || n), 1, 8) AS BIGINT) % 40 AS a, CAST('0x' || substr(md5('b|' || n), 1, 8) AS BIGINT) % 40 AS b FROM range(4096) t(n))
SELECT a * 40 + b AS pair, min(number) AS number FROM c WHERE a <> b GROUP BY 1 ORDER BY 2 LIMIT 500"""
)
def rejection_sample(spark: SparkSession, d: str) -> DataFrame:
    def make(start: int, size: int) -> DataFrame:
        rows = spark.range(start, start + size).withColumnRenamed("id", "number")
        pick = lambda s: F.conv(F.substring(sampling.draw("number", s), 1, 8), 16, 10).cast("long") % 40
        return rows.withColumn("a", pick("a")).withColumn("b", pick("b")).withColumn("pair", F.col("a") * 40 + F.col("b"))

    return sampling.rejected_until(make, F.col("a") != F.col("b"), 500, "pair", 4096)


_U = "CAST('0x' || substr(md5('{}|' || {}), 1, 13) AS BIGINT) / 4503599627370496.0"
_WEIGHTS = {"en": 5.0, "fr": 3.0, "de": 2.0, "es": 0.0}
_BLOCK_SOURCE = "CASE WHEN u < 0.5 THEN 'en' WHEN u < 0.8 THEN 'fr' ELSE 'de' END"


@query(
    f"""WITH {SQL_DOC_WORDS}, s AS (SELECT lang AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS g, token FROM
  (SELECT doc_id, lang, unnest(words) AS token, generate_subscripts(words, 1) AS i FROM dw JOIN documents USING (doc_id) WHERE lang <> 'es')),
n AS (SELECT source, count(*) // 128 AS n_blocks FROM s GROUP BY source),
draws AS (SELECT block_no, {_BLOCK_SOURCE} AS source FROM (SELECT b AS block_no, {_U.format(13, "b")} AS u FROM (SELECT unnest(range((SELECT count(*) * 3 // 10 FROM documents))) AS b))),
o AS (SELECT block_no, d.source, (row_number() OVER (PARTITION BY d.source ORDER BY block_no) - 1) % n_blocks AS source_block FROM draws d JOIN n USING (source))
SELECT block_no, o.source, source_block, min(token) AS least, max(token) AS most FROM o JOIN s ON s.source = o.source AND s.g // 128 = source_block GROUP BY block_no, o.source, source_block"""
)
def mixture_per_block(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("pos"), T.words("text").alias("words"))
    got = mixture.per_block(docs, _WEIGHTS, n_blocks=docs.count() * 3 // 10, size=128, seed=13)
    return got.groupBy("block_no", "source", "source_block").agg(F.min("token").alias("least"), F.max("token").alias("most"))


@query(
    f"""WITH draws AS (SELECT doc_no, {_BLOCK_SOURCE} AS source FROM (SELECT b AS doc_no, {_U.format(17, "b")} AS u FROM (SELECT unnest(range((SELECT count(*) * 2 // 5 FROM documents))) AS b))),
docs AS (SELECT lang AS source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS at, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_no, d.source, doc_id FROM (SELECT doc_no, source, row_number() OVER (PARTITION BY source ORDER BY doc_no) - 1 AS k FROM draws) d JOIN docs ON docs.source = d.source AND docs.at = d.k % docs.n"""
)
def mixture_per_document(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("pos"))
    return mixture.per_document(docs, _WEIGHTS, n_docs=docs.count() * 2 // 5, seed=17).select("doc_no", "source", F.col("pos").alias("doc_id"))


@query(
    f"""WITH {SQL_DOC_WORDS}, draws AS (SELECT doc_no, {_BLOCK_SOURCE} AS source FROM (SELECT b AS doc_no, {_U.format(19, "b")} AS u FROM (SELECT unnest(range((SELECT count(*) * 3 // 10 FROM documents))) AS b))),
docs AS (SELECT lang AS source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS at, count(*) OVER (PARTITION BY lang) AS n FROM documents),
m AS (SELECT doc_no, doc_id FROM (SELECT doc_no, source, row_number() OVER (PARTITION BY source ORDER BY doc_no) - 1 AS k FROM draws) d JOIN docs ON docs.source = d.source AND docs.at = d.k % docs.n),
s AS (SELECT row_number() OVER (ORDER BY doc_no, i) - 1 AS g, token FROM (SELECT doc_no, unnest(words) AS token, generate_subscripts(words, 1) AS i FROM m JOIN dw USING (doc_id)))
SELECT g // 256 AS block_id, md5(string_agg(token, ' ' ORDER BY g)) AS digest FROM s WHERE g // 256 < (SELECT count(*) // 256 FROM s) GROUP BY 1"""
)
def mixture_shared_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Documents drawn by weight, all packed into blocks through one buffer."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("pos"), T.words("text").alias("words"))
    got = mixture.per_document(docs, _WEIGHTS, n_docs=docs.count() * 3 // 10, seed=19).select(F.col("doc_no").alias("pos"), "words")
    return tokens.packed(tokens.placed(got), 256).select("block_id", F.md5(F.array_join("input_ids", " ")).alias("digest"))


@query("SELECT doc_id, doc_id % 8 AS shard FROM documents")
def shard_modulo(spark: SparkSession, d: str) -> DataFrame:
    return mixture.sharded(table(spark, d, "documents").select("doc_id"), "doc_id", 8)


@query("SELECT t.n AS seq, doc_id FROM (SELECT unnest(range((SELECT count(*) * 5 // 2 FROM documents))) AS n) t JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS c FROM documents) ON k = t.n % c")
def cycled_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return mixture.cycled(sampling.numbered(docs, "doc_id", "at"), "at", docs.count() * 5 // 2).select("seq", "doc_id")
