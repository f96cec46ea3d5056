"""Tables and SQL that many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus

#: White space at both ends and inside, as DuckDB's patterns have it.
STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SQL_LINES = """lines AS (SELECT doc_id, CAST(doc_id AS HUGEINT) * 4294967296 + i - 1 AS pos, s AS text FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
SQL_BARE = SQL_LINES + ", bare AS (SELECT * FROM (SELECT doc_id, pos, " + STRIP.format("text") + " AS text FROM lines) WHERE text <> '')"
SQL_DOC_WORDS = r"""dw AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents)"""
SQL_STREAM = (
    SQL_DOC_WORDS
    + """, stream AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, i) - 1 AS g, token FROM
  (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS i FROM dw))"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out: the reader may cut a table into a few large splits, and splitting texts takes long."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(documents(spark, sf_dir))


def bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.nonempty(lines(spark, sf_dir))


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos (the document's id) and words."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("pos"), "doc_id", T.words("text").alias("words"))


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """df with positions (pos, or the columns) as text: they are decimals of up to 38 digits."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("pos",)})


def number(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns as long."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
