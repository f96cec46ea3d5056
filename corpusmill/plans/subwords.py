"""Subword tokens, anchors and scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, evaluate, scoring, subwords
from ..sources.tables import stored
from .base import number, table
from .catalog import query

#: Entries of the vocabularies: whole words, and pairs and triples of letters inside of words.
WHOLE, PARTS = 1500, 1500


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = stored(table(spark, d, "documents").select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    whole = words.select(F.concat(F.lit("▁"), "word").alias("token"), "n")
    cuts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - k + 1, F.lit(0))), lambda i: F.substr("word", i, F.lit(k)))
    parts = words.where(F.length("word") > 3).select(F.explode(F.concat(cuts(2), cuts(3))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    most = lambda rows, k: rows.orderBy(F.desc("n"), "token").limit(k).select("token")
    rows = most(whole, WHOLE).union(most(parts, PARTS)).union(spark.range(1).select(F.lit("▁").alias("token"))).distinct()
    return stored(rows.select("token", F.hash("token").alias("id")), "subwords")


_VOCABULARY = f"""c AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word FROM documents) GROUP BY word),
p AS (SELECT substr(word, i, k) AS token, sum(n) AS n FROM c, (SELECT unnest([2, 3]) AS k), (SELECT unnest(range(1, 400)) AS i) WHERE length(word) > 3 AND i + k - 1 <= length(word) GROUP BY 1),
v AS MATERIALIZED (SELECT '▁' || word AS token FROM (SELECT word FROM c ORDER BY n DESC, word LIMIT {WHOLE}) UNION SELECT token FROM (SELECT token FROM p ORDER BY n DESC, token LIMIT {PARTS}) UNION SELECT '▁')"""


def _cut(words: str) -> str:
    """SQL of pieces: word, k (from 0), b (its place from 1, the mark included), len and known of each word's tokens."""
    return f"""w AS MATERIALIZED ({words}), sizes AS (SELECT DISTINCT length(token) AS l FROM v),
m AS MATERIALIZED (SELECT word, b, coalesce(max(l) FILTER (v.token IS NOT NULL), 1) AS len, max(l) FILTER (v.token IS NOT NULL) IS NOT NULL AS known
  FROM (SELECT word, unnest(range(1, length(word) + 2)) AS b FROM w) JOIN sizes ON b + l - 1 <= length(word) + 1 LEFT JOIN v ON v.token = substr('▁' || word, b, l) GROUP BY ALL),
pieces AS (WITH RECURSIVE r AS (SELECT word, 0 AS k, b, len, known FROM m WHERE b = 1 UNION ALL SELECT m.word, r.k + 1, m.b, m.len, m.known FROM r JOIN m ON m.word = r.word AND m.b = r.b + r.len) SELECT * FROM r)"""


_PLACED = r"""x AS (SELECT {key}, part, i, CAST(coalesce(sum(length(part)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM
  (SELECT {key}, unnest(regexp_extract_all(text, '\S+|\s+')) AS part, generate_subscripts(regexp_extract_all(text, '\S+|\s+'), 1) AS i FROM {table})),
t AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i, k) - 1 AS token_no, substr('▁' || word, b, len) AS token, known, greatest(s + b - 2, s) AS start, greatest(s + b - 2 + len, s) AS "end"
  FROM x JOIN pieces ON word = part)"""
_OF = r"SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word FROM {0}"


@query(f"WITH RECURSIVE {_VOCABULARY}, {_cut(_OF.format('benchmark'))}, {_PLACED.format(key='item_id', table='benchmark')} SELECT item_id, token_no, token, known, start, \"end\" FROM t")
def subword_spans(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of one table by the vocabulary of another, with their places."""
    got = subwords.tokens(table(spark, d, "benchmark"), "item_id", _vocabulary(spark, d))
    return number(got.select("item_id", "token_no", "token", F.col("id").isNotNull().alias("known"), "start", "end"), "token_no", "start", "end")


@query(
    f"""WITH RECURSIVE {_VOCABULARY}, {_cut(_OF.format('conversations'))}, c2 AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations), {_PLACED.format(key='turn_id', table='c2')},
a AS (SELECT turn_id, length(text) // 3 AS a_start, length(text) // 3 + 5 AS a_end FROM c2)
SELECT a.turn_id, min(token_no) AS token_no, count(*) AS n_tokens FROM a JOIN t ON t.turn_id = a.turn_id AND start < a_end AND "end" > a_start GROUP BY a.turn_id"""
)
def subword_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The first subword that overlaps a span of characters, and how many do."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    third = F.floor(F.length("text") / 3)
    got = evaluate.overlaps(turns.select("turn_id", third.alias("a_start"), (third + 5).alias("a_end")), subwords.tokens(turns, "turn_id", _vocabulary(spark, d)), "turn_id")
    return number(got, "token_no")


_WINDOW = 64


@query(
    f"""WITH RECURSIVE {_VOCABULARY}, {_cut(_OF.format('conversations'))}, c2 AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations), {_PLACED.format(key='turn_id', table='c2')},
l AS (SELECT turn_id, token, token_no, max(token_no) OVER (PARTITION BY turn_id) + 1 AS size FROM t QUALIFY token_no >= size - {_WINDOW}), u AS (SELECT token, count(*) AS n FROM l GROUP BY token),
a AS (SELECT sum(n) AS n_all, count(*) AS n_vocab FROM u)
SELECT turn_id, count(*) AS n_tokens, round(exp(-avg(ln((n + 1) / (n_all + n_vocab + 1)))), 6) AS perplexity FROM l JOIN u USING (token), a GROUP BY turn_id"""
)
def subword_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of the last 64 subwords of each turn, by their counts."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    seen = stored(subwords.last_tokens(stored(subwords.tokens(turns, "turn_id", _vocabulary(spark, d)), "turn-subwords"), "turn_id", _WINDOW), "last-subwords")
    scored = scoring.UnigramScorer(seen).score(seen)
    return scored.groupBy("turn_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(scoring.perplexity(), 6).alias("perplexity"))


@query(r"""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word FROM benchmark), v AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word FROM conversations)
SELECT word, count(*) AS n FROM w WHERE word NOT IN (SELECT word FROM v) GROUP BY word""")
def missing_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of one table that another lacks, and how often they stand there."""
    words = lambda name: table(spark, d, name).select(F.explode(T.words("text")).alias("word"))
    return corpus.missing(words("benchmark"), words("conversations"))
