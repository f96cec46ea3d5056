"""Experiments over generated sets and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import corpus, evaluate, experiments, factorial, scoring
from ..operators import generate as G
from . import generation as gen
from .base import SQL_BARE, bare, number, table
from .catalog import query
from .evaluation import _model, _rounded

_QUADS = gen._question_quads("iv")
_TRAIN = (
    f"train AS (SELECT sentence FROM ({gen._wh(gen._A, 'p1', 'n1', 'TRUE')} UNION {gen._wh(gen._B, 'p2', 'n2', 'FALSE')}) UNION ALL "
    f"SELECT DISTINCT {gen._DECL} || '.' FROM {gen._A}, {gen._B}, {gen._rows(('base', 'past', 'ing'), L.QUESTION_VERBS)}, {gen._MODS}, {gen._un('tense', ['past', 'present', 'prog'])})"
)


def _skip_pairs(sentences: DataFrame, column: str = "sentence") -> DataFrame:
    """prev, the first word, with each later word or mark of its sentence."""
    ws = T.words(F.regexp_replace(column, r"([.?])$", " $1"))
    return sentences.select(ws.alias("ws")).select(F.col("ws")[0].alias("prev"), F.explode(F.slice("ws", 2, F.size("ws") - 1)).alias("token"))


def _scored_quads(spark: SparkSession) -> DataFrame:
    train = G.questions(spark).where("kind = 'wh'").select("sentence").unionByName(G.declaratives(spark).select("sentence"))
    scorer = scoring.CountScorer(_skip_pairs(train), k=0.5)
    quads = G.factorial_questions(spark, "iv").select(F.col("quadruplet_id").alias("item"), "filler", "gap", F.col("filler_word").alias("prev"), F.col("post_gap_text").alias("token"))
    return scorer.score(quads).withColumn("y", -F.col("logp"))


@query(
    f"WITH quads AS ({_QUADS}), {_TRAIN}, t AS (SELECT list_filter(string_split(regexp_replace(sentence, '([.?])$', ' \\1'), ' '), lambda x: x <> '') AS ws FROM train), "
    "sp AS (SELECT ws[1] AS prev, unnest(ws[2:]) AS token FROM t), p AS (SELECT prev, token, count(*) AS n_pair FROM sp GROUP BY prev, token), q AS (SELECT prev, sum(n_pair) AS n_prev FROM p GROUP BY prev), v AS (SELECT count(DISTINCT token) AS n FROM p), "
    "s AS (SELECT filler, gap, -ln((coalesce(n_pair, 0) + 0.5::DOUBLE) / (coalesce(n_prev, 0) + 0.5::DOUBLE * v.n)) AS y FROM quads LEFT JOIN p ON p.prev = filler_word AND p.token = post_gap_text LEFT JOIN q ON q.prev = filler_word, v) "
    "SELECT filler, gap, count(*) AS n, round(avg(y), 6) AS surprisal, round(avg(y) / ln(2.0::DOUBLE), 6) AS surprisal_bits FROM s GROUP BY filler, gap"
)
def filler_gap_surprisal(spark: SparkSession, d: str) -> DataFrame:
    """Surprisal of what follows the gap site under a skip-bigram scorer trained on questions and declaratives."""
    rows = _scored_quads(spark).groupBy("filler", "gap").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("surprisal"), scoring.bits(F.avg("y")).alias("surprisal_bits"))
    return _rounded(rows, "surprisal", "surprisal_bits")


_QUAD_ITEMS = (
    f"quads AS ({_QUADS}), {_TRAIN}, tw AS (SELECT list_filter(string_split(regexp_replace(sentence, '([.?])$', ' \\1'), ' '), lambda x: x <> '') AS ws FROM train), "
    "sp AS (SELECT ws[1] AS prev, unnest(ws[2:]) AS token FROM tw), pc AS (SELECT prev, token, count(*) AS n_pair FROM sp GROUP BY prev, token), qc AS (SELECT prev, sum(n_pair) AS n_prev FROM pc GROUP BY prev), vc AS (SELECT count(DISTINCT token) AS n FROM pc), "
    "items AS (SELECT quadruplet_id AS item, filler, gap, -ln((coalesce(n_pair, 0) + 0.5::DOUBLE) / (coalesce(n_prev, 0) + 0.5::DOUBLE * vc.n)) AS y FROM quads LEFT JOIN pc ON pc.prev = filler_word AND pc.token = post_gap_text LEFT JOIN qc ON qc.prev = filler_word, vc)"
)
_ESTIMATES = ["b_0", "b_filler", "b_gap", "b_interaction", "se_0", "se_main", "se_interaction", "sigma2", "z_filler", "z_gap", "z_interaction", "licensing", "licensing_low", "licensing_high"]
_REACH = "1.959963984540054 * sqrt(4 * sigma2 / n_items)"


@query(
    _model(_QUAD_ITEMS)
    + ", e AS (SELECT *, sqrt(sigma2 / n_items) AS se_main, sqrt(4 * sigma2 / n_items) AS se_interaction, b_filler / sqrt(sigma2 / n_items) AS z_filler, b_gap / sqrt(sigma2 / n_items) AS z_gap, b_interaction / sqrt(4 * sigma2 / n_items) AS z_interaction, "
    f"-b_interaction AS licensing, -b_interaction - {_REACH} AS licensing_low, -b_interaction + {_REACH} AS licensing_high FROM r) SELECT n_items, n_dropped, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _ESTIMATES)
    + " FROM e"
)
def filler_gap_model(spark: SparkSession, d: str) -> DataFrame:
    """The mixed model over the scored quadruplets."""
    return _rounded(factorial.mixed_model(_scored_quads(spark)), *_ESTIMATES).select("n_items", "n_dropped", *_ESTIMATES)


_TAIL = "list_filter(string_split({}, ' '), lambda x: x <> '')[-4:]"


@query(
    f"WITH quads AS ({gen._clause_quads('iv')}), one AS (SELECT quadruplet_id, "
    + ", ".join(f"any_value({c}) FILTER (filler = {k}) AS {s}_{c}" for k, s in ((0, "base"), (1, "source")) for c in ("sentence", "pre_gap_text", "post_gap_text"))
    + " FROM quads WHERE gap = 1 GROUP BY quadruplet_id) "
    "SELECT quadruplet_id, ['relativizer', 'the', 'noun', 'verb'][i] AS position_label, base_sentence AS base_text, source_sentence AS source_text, string_split(base_post_gap_text, ' ')[1] AS yb, string_split(source_post_gap_text, ' ')[1] AS ys, "
    f"({_TAIL.format('base_pre_gap_text')})[i] AS base_anchor, ({_TAIL.format('source_pre_gap_text')})[i] AS source_anchor FROM one, (SELECT unnest([1, 2, 3, 4]) AS i)"
)
def pair_rows_by_quadruplet(spark: SparkSession, d: str) -> DataFrame:
    return experiments.intervention_pairs(G.factorial_clauses(spark, "iv"))


@query(f"WITH quads AS ({gen._clause_quads('iv')}) SELECT quadruplet_id, filler, gap, CAST(list_position(string_split(sentence, ' '), filler_word) - 1 AS INTEGER) AS token_no FROM quads")
def anchor_token_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = G.factorial_clauses(spark, "iv").withColumn("key", F.struct("quadruplet_id", "filler", "gap"))
    return experiments.anchor_tokens(rows, "key", "sentence", "filler_word").select("key.*", "token_no")


@query(
    f"WITH s AS (SELECT {gen._TC} || ' ' || tail || '.' AS sentence, n1, n2, rel {gen._T} WHERE n1 <> n2) "
    "SELECT 'the ' || n1 AS moved_np, CASE WHEN rel <> '' THEN 'the ' || n2 END AS embedded_np, count(*) AS n FROM s GROUP BY ALL"
)
def np_extraction(spark: SparkSession, d: str) -> DataFrame:
    ws = T.words("sentence")
    nouns = sorted({*L.ANIMATE_1, *L.ANIMATE_2})
    rows = G.transitivity(spark).select(T.moved_np(ws, nouns).alias("moved_np"), T.embedded_np(ws, nouns).alias("embedded_np"))
    return rows.groupBy("moved_np", "embedded_np").agg(F.count(F.lit(1)).alias("n"))


_DISTRACT = f"d AS ({gen._distract(L.ANIMATE_1, L.INANIMATE_OBJECTS, ['that', 'who'], 'animate', 'no')} UNION ALL {gen._distract(L.INANIMATE_1, L.ANIMATE_OBJECTS, ['that'], 'inanimate', 'yes')})"


@query(
    f"WITH {_DISTRACT}, w AS (SELECT lower(regexp_replace(unnest(string_split(sentence, ' ')), '[.]$', '')) AS token FROM d), c AS (SELECT token, count(*) AS n FROM w GROUP BY token), t AS (SELECT sum(n) AS n_all, count(*) AS n_vocab FROM c), "
    "o AS (SELECT pre_gap_text, sentence, string_split(pre_gap_text, ' ')[-1] AS verb, string_split(moved_np, ' ')[-1] AS moved, list_transform(string_split(plausible_objects, '|'), lambda x: string_split(x, ' ')[-1]) AS objects FROM d), "
    "e AS (SELECT sentence, verb, moved, unnest(objects) AS object FROM o), "
    "p AS (SELECT sentence, verb, any_value((coalesce(m.n, 0) + 1.0::DOUBLE) / (n_all + n_vocab + 1)) AS p_moved, avg((coalesce(k.n, 0) + 1.0::DOUBLE) / (n_all + n_vocab + 1)) AS p_objects FROM e LEFT JOIN c m ON m.token = moved LEFT JOIN c k ON k.token = object, t GROUP BY sentence, verb) "
    "SELECT coalesce(verb, 'ALL') AS verb, count(*) AS n, round(avg(p_moved), 9) AS moved_mean, round(avg(p_objects), 9) AS objects_mean, round(median(p_moved - p_objects), 9) AS difference_median FROM p GROUP BY ROLLUP(verb)"
)
def distractor_mass(spark: SparkSession, d: str) -> DataFrame:
    """Mass of the moved noun against the mean of the plausible objects, per verb and over all."""
    rows = G.distractors(spark)
    tokens = rows.select(F.explode(T.words("sentence")).alias("w")).select(T.normalize_word_right("w").alias("token"))
    scorer = scoring.UnigramScorer(tokens, k=1.0)
    items = rows.select("sentence", T.last_word("pre_gap_text").alias("verb"), T.last_word("moved_np").alias("moved"), T.split_multi("plausible_objects").alias("objects"))
    cands = items.select("sentence", "verb", F.lit("moved").alias("kind"), F.col("moved").alias("token")).unionByName(
        items.select("sentence", "verb", F.lit("object").alias("kind"), F.explode("objects").alias("o")).select("sentence", "verb", "kind", T.last_word("o").alias("token"))
    )
    p = F.exp("logp")
    per = scorer.score(cands).groupBy("sentence", "verb").agg(F.avg(F.when(F.col("kind") == "moved", p)).alias("a"), F.avg(F.when(F.col("kind") == "object", p)).alias("b"))
    got = per.rollup("verb").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("moved_mean"), F.avg("b").alias("objects_mean"), F.median(F.col("a") - F.col("b")).alias("difference_median"), F.grouping("verb").alias("_all"))
    got = got.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("verb")).alias("verb"), "n", *(F.round(c, 9).alias(c) for c in ("moved_mean", "objects_mean", "difference_median")))
    return got


@query("SELECT a.lang AS corpus_lang, e.event_type AS task_event_type, a.n AS corpus_n, e.n AS task_n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a, (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) e")
def run_dimensions(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t, c: table(spark, d, t).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return experiments.dimensions(corpus=count("documents", "lang"), task=count("events", "event_type"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_evaluated_yet(spark: SparkSession, d: str) -> DataFrame:
    return experiments.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT source, round(avg(n_chars), 6) AS mean, round(avg(n_chars) - (SELECT avg(n_chars) FROM documents), 6) AS delta_mean FROM documents GROUP BY source")
def baseline_difference(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.groupBy("source").agg(F.avg("n_chars").alias("mean"))
    return _rounded(experiments.less_baseline(rows, docs.agg(F.avg("n_chars").alias("mean")), "mean"), "mean", "delta_mean")


@query("SELECT doc_id AS pos, length(text) AS n_left, n_chars AS n_right FROM documents")
def aligned_by_position(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    left = docs.select(F.col("doc_id").alias("pos"), F.length("text").cast("long").alias("n_left"))
    return experiments.aligned(left, docs.select(F.col("doc_id").alias("pos"), F.col("n_chars").alias("n_right")))


@query("SELECT i AS step, round(greatest(1.0::DOUBLE * pow(0.97::DOUBLE, i), 0.2), 6) AS temperature FROM range(200) t(i)")
def decay_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(experiments.decay(spark, 1.0, 0.97, 200, 0.2), "temperature")


@query("SELECT unnest(list_sort(list_distinct(list_concat([i * 200 for i in range(1, 26)], [5017])))) AS step")
def evaluation_steps(spark: SparkSession, d: str) -> DataFrame:
    return number(evaluate.evaluation_steps(spark, 200, 5017), "step")


@query(
    """WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'train_orc_' || doc_id || '_augmented' WHEN 1 THEN 'train_orc_baseline_wh_' || doc_id WHEN 2 THEN 'wh_baseline' ELSE 'train_' END AS name FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'orc_' || doc_id WHEN 1 THEN 'wh_' || doc_id WHEN 2 THEN 'wh' ELSE 'train' END AS tag FROM n"""
)
def train_tags(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("train_orc_"), n, F.lit("_augmented"))).when(k == 1, F.concat(F.lit("train_orc_baseline_wh_"), n)).when(k == 2, "wh_baseline").otherwise("train_")
    return table(spark, d, "documents").select("doc_id", experiments.train_tag(name).alias("tag"))


@query(f"WITH {SQL_BARE}, a AS (SELECT DISTINCT text FROM bare WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT text FROM bare WHERE doc_id % 2 = 1) SELECT 'union' AS op, count(*) AS n FROM (SELECT text FROM a UNION SELECT text FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT text FROM a INTERSECT SELECT text FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT text FROM a EXCEPT SELECT text FROM b)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = (bare(spark, d).where(f"doc_id % 2 = {k}").select("text") for k in (0, 1))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    rows = [p.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n")) for op, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(r"WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word FROM benchmark), v AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM w WHERE word NOT IN (SELECT word FROM v))")
def rows_of_known_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", T.words("text").alias("words"))
    vocab = table(spark, d, "documents").select(F.explode(T.words("text")).alias("word"))
    return corpus.all_known(rows, "item_id", "words", vocab).select("item_id")


@query(r"WITH v AS (SELECT DISTINCT lower(unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS word FROM documents) SELECT word, 'noun' AS kind FROM v WHERE regexp_matches(word, '(tion|ment|ness|ity|er|or|ist|ship|age)$') UNION ALL SELECT word, 'verb' FROM v WHERE regexp_matches(word, '(ed|ing)$') OR word IN (" + ", ".join(f"'{w}'" for w in T.VERB_SEEDS) + ")")
def suffix_lexicons(spark: SparkSession, d: str) -> DataFrame:
    return corpus.lexicons(table(spark, d, "documents").select(F.explode(T.words("text")).alias("word")))


@query(
    f"WITH quads AS ({gen._clause_quads('iv')}), w AS (SELECT string_split(regexp_replace(sentence, '[.]$', ''), ' ') AS ws FROM quads), b AS (SELECT unnest(ws[:-2]) AS prev, unnest(ws[2:]) AS token FROM w), "
    "p AS (SELECT prev, token, count(*) AS n_pair FROM b GROUP BY prev, token), q AS (SELECT prev, sum(n_pair) AS n_prev FROM p GROUP BY prev), v AS (SELECT count(DISTINCT token) AS n FROM p), "
    f"x AS (SELECT DISTINCT pre_gap_text AS item_id, string_split(pre_gap_text, ' ')[-1] AS last FROM quads), c AS (SELECT slot, cand, string_split(cand, ' ') AS ws FROM ({gen._candidates('clause', 'iv')})), "
    "r AS (SELECT item_id, slot, cand, i, token, CASE WHEN i = 1 THEN last ELSE ws[i - 1] END AS prev FROM (SELECT item_id, last, slot, cand, ws, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM x, c)), "
    "s AS (SELECT item_id, slot, cand, exp(avg(ln((coalesce(n_pair, 0) + 0.5::DOUBLE) / (coalesce(n_prev, 0) + 0.5::DOUBLE * v.n)))) AS g FROM r LEFT JOIN p ON p.prev = r.prev AND p.token = r.token LEFT JOIN q ON q.prev = r.prev, v GROUP BY item_id, slot, cand), "
    "m AS (SELECT slot, item_id, avg(g) AS g FROM s GROUP BY slot, item_id) SELECT slot, count(*) AS n_items, round(avg(g), 9) AS mean_mass FROM m GROUP BY slot"
)
def context_candidate_masses(spark: SparkSession, d: str) -> DataFrame:
    """Probability masses of noun phrases, verb phrases and the question mark after the contexts of the quadruplets."""
    quads = G.factorial_clauses(spark, "iv")
    words = quads.select((F.col("quadruplet_id") * 4 + F.col("filler") * 2 + F.col("gap")).alias("pos"), T.words(F.regexp_replace("sentence", "[.]$", "")).alias("words"))
    contexts = quads.select(F.col("pre_gap_text").alias("item_id"), F.col("pre_gap_text").alias("text")).distinct()
    got = evaluate.candidate_masses(contexts, G.candidates(spark, "clause", "iv"), scoring.CountScorer(scoring.bigrams(words), k=0.5))
    return got.withColumn("mean_mass", F.round("mean_mass", 9))
