"""Curation of sentence corpora over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, sampling, tokens
from ..sources.tables import stored
from .base import SQL_BARE, SQL_DOC_WORDS, SQL_LINES, SQL_STREAM, STRIP, bare, doc_words, lines, number, shown, table
from .catalog import query

W = f"WITH {SQL_BARE} "


@query(W + "SELECT CAST(pos AS VARCHAR) AS pos, text FROM bare")
def lines_nonempty(spark: SparkSession, d: str) -> DataFrame:
    return shown(bare(spark, d).select("pos", "text"))


@query(f"WITH {SQL_LINES} SELECT CAST(pos AS VARCHAR) AS pos, text FROM lines WHERE " + STRIP.format("text") + " <> ''")
def lines_unstripped(spark: SparkSession, d: str) -> DataFrame:
    return shown(corpus.nonempty(lines(spark, d), keep_spaces=True).select("pos", "text"))


@query(W + "SELECT text, CAST(min(pos) AS VARCHAR) AS pos, count(*) AS copies FROM bare GROUP BY text")
def dedupe_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return shown(corpus.first_occurrences(bare(spark, d)))


@query(W + "SELECT count(*) AS n_lines, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_removed FROM bare")
def duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    once = corpus.first_occurrences(bare(spark, d))
    n, unique = F.sum("copies"), F.count(F.lit(1))
    return once.agg(n.alias("n_lines"), unique.alias("n_unique"), (n - unique).alias("n_removed"))


@query("SELECT lang, source, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY lang, source")
def distinct_on_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


_MARKED = "CASE WHEN pos % 3 = 0 THEN text || ' <eos>' WHEN pos % 3 = 1 THEN '<unk> ' || text ELSE text END"


def _marked() -> F.Column:
    return F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit(" <eos>"))).when(F.col("pos") % 3 == 1, F.concat(F.lit("<unk> "), "text")).otherwise(F.col("text"))


_CAP1 = "upper(substr(t, 1, 1)) || substr(t, 2)"


@query(
    W
    + f""", m AS (SELECT pos, {_MARKED} AS t FROM bare), s AS (SELECT pos, t, {STRIP.format("t")} AS b FROM m)
SELECT CAST(pos AS VARCHAR) AS pos, CASE WHEN ends_with(replace(replace(b, '<unk>', ''), '<eos>', '<|endoftext|>'), '<|endoftext|>') THEN replace(replace(b, '<unk>', ''), '<eos>', '<|endoftext|>')
  ELSE replace(replace(b, '<unk>', ''), '<eos>', '<|endoftext|>') || ' <|endoftext|>' END AS preprocessed,
  CASE WHEN ends_with(replace(b, '<unk>', '[MISSING]'), '<|endoftext|>') THEN replace(b, '<unk>', '[MISSING]') ELSE replace(b, '<unk>', '[MISSING]') || '<|endoftext|>' END AS before_tokens,
  CASE WHEN ends_with(b, '.') THEN upper(substr(b, 1, 1)) || substr(b, 2) ELSE upper(substr(b, 1, 1)) || substr(b, 2) || '.' END || ' <eos>' AS formatted FROM s"""
)
def preprocess_sentence(spark: SparkSession, d: str) -> DataFrame:
    rows = bare(spark, d).select("pos", _marked().alias("t"))
    return shown(rows).select("pos", T.preprocess("t").alias("preprocessed"), T.before_tokens("t").alias("before_tokens"), T.format_eos("t").alias("formatted"))


@query(
    f"""WITH {SQL_LINES}, w AS (SELECT pos, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM lines)
SELECT CAST(pos AS VARCHAR) AS pos, upper(substr(s, 1, 1)) || lower(substr(s, 2)) AS capitalized, upper(substr(s, 1, 1)) || substr(s, 2) AS first_upper, s AS squeezed,
  lower(regexp_replace(ws[1], '^[.,?!;:"''()\\[\\]{{}}]+|[.,?!;:"''()\\[\\]{{}}]+$', '', 'g')) AS word_both,
  lower(regexp_replace(ws[-1], '[.,!?;:]+$', '')) AS word_right
FROM (SELECT *, regexp_replace({STRIP.format("text")}, '[\\s\\p{{Z}}]+', ' ', 'g') AS s FROM w)"""
)
def capitalize_normalize(spark: SparkSession, d: str) -> DataFrame:
    s = T.squeeze("text")
    return shown(lines(spark, d)).select(
        "pos", T.capitalize(s).alias("capitalized"), T.capitalize_first(s).alias("first_upper"), s.alias("squeezed"),
        T.normalize_word(T.first_word("text")).alias("word_both"), T.normalize_word_right(T.last_word("text")).alias("word_right"),
    )


@query(
    W
    + """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE contains(text, 'that') OR contains(text, 'who')) AS n_marked,
  round(100 * avg(CASE WHEN contains(text, 'that') OR contains(text, 'who') THEN 1.0 ELSE 0 END), 6) AS frequency FROM bare GROUP BY doc_id"""
)
def structure_frequency(spark: SparkSession, d: str) -> DataFrame:
    marked = F.contains("text", F.lit("that")) | F.contains("text", F.lit("who"))
    rows = bare(spark, d)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(marked).alias("n_marked"), F.round(corpus.structure_frequency(rows, marked), 6).alias("frequency"))


_BENCH = "bench AS (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark)"


def _bench_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("text"))


@query(f"WITH {SQL_LINES}, {_BENCH} SELECT text, CAST(min(pos) AS VARCHAR) AS pos FROM lines WHERE text NOT IN (SELECT text FROM bench) GROUP BY text")
def holdout_antijoin_exact(spark: SparkSession, d: str) -> DataFrame:
    return shown(corpus.hold_out(lines(spark, d), _bench_lines(spark, d), exact=True))


@query(
    f"WITH {SQL_LINES}, {_BENCH}, k AS (SELECT pos, text, "
    + STRIP.format("replace(text, '<|endoftext|>', '')")
    + " AS key FROM lines), b AS (SELECT DISTINCT "
    + STRIP.format("replace(text || ' <|endoftext|>', '<|endoftext|>', '')")
    + " AS key FROM bench) SELECT min_by(text, pos) AS text, CAST(min(pos) AS VARCHAR) AS pos FROM k WHERE key NOT IN (SELECT key FROM b) GROUP BY key"
)
def holdout_antijoin_normalized(spark: SparkSession, d: str) -> DataFrame:
    train = _bench_lines(spark, d).withColumn("text", F.concat("text", F.lit(" " + T.END)))
    return shown(corpus.hold_out(lines(spark, d), train))


_VOCAB = r"""w AS (SELECT pos, i, word FROM (SELECT pos, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM
  (SELECT pos, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM lines))),
v AS (SELECT word, CAST(row_number() OVER (ORDER BY min(pos * 2147483648 + i)) - 1 AS BIGINT) AS idx, count(*) AS freq FROM w GROUP BY word)"""


@query(f"WITH {SQL_LINES}, {_VOCAB} SELECT word, idx, freq FROM v")
def vocab_build(spark: SparkSession, d: str) -> DataFrame:
    return number(corpus.vocabulary(corpus.words_of(lines(spark, d))), "idx")


_BW = r"bw AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS word_no FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark))"


@query(f"WITH {SQL_LINES}, {_VOCAB}, {_BW} SELECT item_id, word_no, word, coalesce(idx, -1) AS idx FROM bw LEFT JOIN v USING (word)")
def encode_with_unk(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(T.words("text")).alias("word_no", "word"))
    return number(corpus.encoded(words, corpus.vocabulary(corpus.words_of(lines(spark, d)))), "word_no", "idx").select("item_id", "word_no", "word", "idx")


@query(f"WITH {SQL_LINES}, {_VOCAB}, {_BW} SELECT count(*) AS n_words, count(idx) AS ok, count(*) - count(idx) AS bad FROM (SELECT DISTINCT word FROM bw) LEFT JOIN v USING (word)")
def vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("word"))
    return corpus.coverage(words, corpus.words_of(lines(spark, d)).select("word").distinct())


@query(
    r"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents)
SELECT doc_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars, min(sentence) AS least FROM p GROUP BY doc_id"""
)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.explode(T.sentences("text")).alias("sentence"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.min("sentence").alias("least"))


@query(
    W
    + """, u AS (SELECT text, min(pos) AS pos FROM bare GROUP BY text), h AS (SELECT text, pos FROM u WHERE text NOT IN (
  SELECT """
    + STRIP.format("s")
    + """ FROM (SELECT unnest(string_split(text, chr(10))) AS s FROM benchmark))),
s AS (SELECT * FROM h WHERE CAST('0x' || substr(md5('42|' || pos), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.5),
w AS (SELECT pos, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM (SELECT pos, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM s)),
g AS (SELECT pos, row_number() OVER (ORDER BY pos, i) - 1 AS g FROM w)
SELECT g // 1024 AS block_id, count(*) AS n_tokens, count(DISTINCT pos) AS n_lines FROM g WHERE g // 1024 < (SELECT count(*) // 1024 FROM g) GROUP BY 1"""
)
def curate_and_pack(spark: SparkSession, d: str) -> DataFrame:
    """Lines without repeats and without benchmark lines, half of them by hash, packed into blocks of 1024 words."""
    held = corpus.hold_out(bare(spark, d), _bench_lines(spark, d).withColumn("text", T.strip("text")), exact=True)
    some = stored(held.where(sampling.uniform("pos", 42) < 0.5).select("pos", "text"), "curated").select("pos", T.words("text").alias("words"))
    rows = tokens.slices(tokens.placed(some), 1024)
    return rows.groupBy("block_id").agg(F.sum(F.size("tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_lines"))


@query(
    f"WITH {SQL_BARE}, w AS (SELECT pos, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM bare), e AS (SELECT pos, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w) "
    "SELECT CAST(pos AS VARCHAR) AS pos, CAST(i - 1 AS BIGINT) AS word_no, word, CAST(coalesce(sum(length(word) + 1) OVER p, 0) AS BIGINT) AS start, CAST(coalesce(sum(length(word) + 1) OVER p, 0) + length(word) AS BIGINT) AS \"end\" "
    "FROM e WINDOW p AS (PARTITION BY pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def word_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = bare(spark, d).select("pos", T.words("text").alias("words"))
    return shown(number(tokens.word_spans(rows), "word_no", "start", "end"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM
  (SELECT conv_id, turn, list_filter(regexp_split_to_array(text || ' <eos>', '\s+'), lambda x: x <> '') AS ws FROM conversations)),
s AS (SELECT *, coalesce(sum(CASE WHEN token = '<eos>' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM t)
SELECT conv_id, segment, count(*) FILTER (WHERE token <> '<eos>') AS n_tokens, min(token) AS least FROM s GROUP BY conv_id, segment"""
)
def eos_segments(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.words(F.concat("text", F.lit(" <eos>")))).alias("i", "token"))
    cut = tokens.segments(turns, "conv_id", ["turn", "i"], F.col("token") == "<eos>")
    return cut.groupBy("conv_id", "segment").agg(F.count_if(F.col("token") != "<eos>").alias("n_tokens"), F.min("token").alias("least"))


@query(
    f"WITH {SQL_STREAM} SELECT g // 1024 AS block_id, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs, md5(string_agg(token, ' ' ORDER BY g)) AS digest FROM stream "
    "WHERE g // 1024 < (SELECT count(*) // 1024 FROM stream) GROUP BY 1"
)
def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens.packed(tokens.placed(doc_words(spark, d)), 1024)
    return rows.select("block_id", F.size("input_ids").cast("long").alias("n_tokens"), F.col("n_rows").alias("n_docs"), F.md5(F.array_join("input_ids", " ")).alias("digest"))


@query(
    f"WITH {SQL_STREAM} SELECT g // 512 AS block_id, count(*) FILTER (WHERE token <> 'the') AS n_labels, count(*) AS n_ids FROM stream "
    "WHERE g // 512 < (SELECT count(*) // 512 FROM stream) GROUP BY 1"
)
def pack_mask_labels(spark: SparkSession, d: str) -> DataFrame:
    got = tokens.packed(tokens.placed(doc_words(spark, d)), 512, masked="the")
    return got.select("block_id", F.size(F.filter("labels", lambda t: t.isNotNull())).cast("long").alias("n_labels"), F.size("input_ids").cast("long").alias("n_ids"))


@query(
    f"WITH {SQL_DOC_WORDS}, r AS (SELECT words, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM dw), t AS (SELECT row_no // 100 AS batch, row_number() OVER (PARTITION BY row_no // 100 ORDER BY row_no, i) - 1 AS g "
    "FROM (SELECT row_no, unnest(words) AS token, generate_subscripts(words, 1) AS i FROM r)) SELECT batch, count(*) // 256 AS n_blocks FROM t GROUP BY batch HAVING count(*) >= 256"
)
def pack_blocks_by_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.numbered(doc_words(spark, d), "pos", "row_no")
    got = tokens.packed_in_batches(rows, 256, batch_rows=100)
    return number(got.groupBy("batch").agg(F.count(F.lit(1)).alias("n_blocks")), "batch")


@query(
    f"WITH {SQL_STREAM}, n AS (SELECT count(*) // 16 AS len FROM stream) SELECT g // len AS lane, count(*) AS n_tokens, count(DISTINCT token) AS n_words, min(g) AS first_g, max(g % len) AS last_t FROM stream, n WHERE g < len * 16 GROUP BY 1"
)
def batchify_lanes(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens.lanes(tokens.positions(doc_words(spark, d)), 16)
    return rows.groupBy("lane").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("token").alias("n_words"), F.min("g").alias("first_g"), F.max("t").alias("last_t"))


@query(
    f"WITH {SQL_STREAM}, b AS (SELECT g // 1024 AS block_id, g, token, lead(token) OVER (PARTITION BY g // 1024 ORDER BY g) AS target FROM stream) "
    "SELECT token, target, count(*) AS n FROM b GROUP BY token, target"
)
def shift_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens.targets(tokens.packed(tokens.placed(doc_words(spark, d)), 1024, keep_rest=True))
    return rows.groupBy("token", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT vec_id // 2 AS pair_id, max(CASE WHEN vec_id % 2 = 0 THEN label END) AS even_label, max(CASE WHEN vec_id % 2 = 1 THEN label END) AS odd_label FROM embeddings GROUP BY 1"
)
def odd_even_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("pair_id", F.floor(F.col("vec_id") / 2))
    return rows.groupBy("pair_id").agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("label"))).alias("even_label"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("label"))).alias("odd_label"))


@query("SELECT least(CAST(floor(n_chars / 500.0) AS BIGINT), 50) AS bin, count(*) AS n FROM documents GROUP BY 1")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    """50 bins of 500 characters and one for what lies above."""
    bucket = F.width_bucket(F.col("n_chars").cast("double"), F.lit(0.0), F.lit(25000.0), F.lit(50)) - 1
    return table(spark, d, "documents").groupBy(bucket.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    W
    + r"""SELECT CAST(pos AS VARCHAR) AS pos, CASE WHEN b <> '' THEN b ELSE text END AS before_question, CASE WHEN p <> '' THEN regexp_replace(p, '\s+$', '') ELSE text END AS through_phrase
FROM (SELECT pos, text, CASE WHEN contains(text, '?') THEN regexp_replace(regexp_extract(text, '(?s)^(.*)\?', 1), '\s+$', '') ELSE '' END AS b, regexp_extract(text, '(?is)^(.*?\b(?:that the|that|the)\b)', 1) AS p FROM bare)"""
)
def context_cuts(spark: SparkSession, d: str) -> DataFrame:
    return shown(bare(spark, d)).select("pos", T.before_question("text").alias("before_question"), T.through_phrase("text", ["the", "that", "that the"]).alias("through_phrase"))
