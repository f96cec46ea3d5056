"""Generators and evaluators with words and scores from the driver's tables: nouns, verbs and others are the most frequent ones of the documents, probabilities those of their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import evaluate, experiments, factorial, masses, mixed, scoring
from ..operators import generate as G
from ..operators.order import numbered, quantiles
from ..sources.tables import stored
from .base import table
from .catalog import query

#: Words of each kind that the queries take.
NOUNS, VERBS, OTHERS = 8, 6, 2
_K = 0.5
_ENDS = {"noun": "(" + "|".join(T.NOUN_ENDINGS) + ")$", "verb": "(" + "|".join(T.VERB_ENDINGS) + ")$"}
_SEEDS = ", ".join(f"'{w}'" for w in T.VERB_SEEDS)

#: Words, neighbours and the lists: nouns, verbs and others with their place k from 0.
_BASE = rf"""dw AS (SELECT list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: lower(x)) AS ws FROM documents),
bg AS (SELECT unnest(ws[:-2]) AS prev, unnest(ws[2:]) AS token FROM dw WHERE len(ws) > 1), p AS MATERIALIZED (SELECT prev, token, count(*) AS n_pair FROM bg GROUP BY prev, token),
q AS MATERIALIZED (SELECT prev, sum(n_pair) AS n_prev FROM p GROUP BY prev), v AS MATERIALIZED (SELECT count(DISTINCT token) AS n FROM p),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM dw) WHERE regexp_matches(word, '^[a-z][a-z]+$') AND word NOT IN ('the', 'that', 'who', 'which') GROUP BY word),
k AS (SELECT word, n, CASE WHEN regexp_matches(word, '{_ENDS["verb"]}') OR word IN ({_SEEDS}) THEN 'verb' WHEN regexp_matches(word, '{_ENDS["noun"]}') THEN 'noun' ELSE 'other' END AS kind FROM c),
lx AS MATERIALIZED (SELECT word, kind, row_number() OVER (PARTITION BY kind ORDER BY n DESC, word) - 1 AS k FROM k),
nouns AS MATERIALIZED (SELECT word, k FROM lx WHERE kind = 'noun' AND k < {NOUNS}), verbs AS MATERIALIZED (SELECT word, k FROM lx WHERE kind = 'verb' AND k < {VERBS}), others AS MATERIALIZED (SELECT word, k FROM lx WHERE kind = 'other' AND k < {OTHERS})"""


def _prob(prev: str, token: str) -> str:
    return f"((coalesce((SELECT n_pair FROM p WHERE p.prev = {prev} AND p.token = {token}), 0) + {_K}::DOUBLE) / (coalesce((SELECT n_prev FROM q WHERE q.prev = {prev}), 0) + {_K}::DOUBLE * (SELECT n FROM v)))"


class _Words:
    """The documents' words in lower case, their scorer and the lists."""

    def __init__(self, spark: SparkSession, d: str):
        self.words = stored(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), T.words(T.lower("text")).alias("words")), "lexical-words")
        self.counts = scoring.word_counts(self.words)
        counts = self.counts.where(F.col("word").rlike("^[a-z][a-z]+$") & ~F.col("word").isin("the", "that", "who", "which")).select("word", "n")
        verb = F.col("word").rlike(_ENDS["verb"]) | F.col("word").isin(*T.VERB_SEEDS)
        kinds = stored(counts.withColumn("kind", F.when(verb, "verb").when(F.col("word").rlike(_ENDS["noun"]), "noun").otherwise("other")), "lexical-kinds")
        first = lambda kind, n: [r["word"] for r in kinds.where(F.col("kind") == kind).orderBy(F.desc("n"), "word").limit(n).collect()]
        self.nouns, self.verbs, self.others = first("noun", NOUNS), first("verb", VERBS), first("other", OTHERS)  # lists of that length
        self.n1, self.n2, half = self.nouns[:6], self.nouns[2:], VERBS // 2
        self.transitive, self.intransitive = self.verbs[:half], self.verbs[half:]

    def scorer(self, *more: str) -> scoring.CountScorer:
        """Scores "the", the words of the lists and more after any word; other pairs aren't counted."""
        return scoring.AskedScorer(self.words, F.col("token").isin("the", *self.nouns, *self.verbs, *self.others, *more), k=_K, counts=self.counts)

    def sentences(self, spark: SparkSession) -> DataFrame:
        return G.transitivity(spark, self.n1, self.n2, self.transitive, self.intransitive, self.others)


_TR = f"""tr AS (SELECT a.word AS n1, b.word AS n2, verbs.word AS verb, CASE WHEN verbs.k < {VERBS // 2} THEN 'transitive' ELSE 'intransitive' END AS verb_type, rel, others.word AS tail,
  'The ' || a.word || CASE WHEN rel = '' THEN '' ELSE ' ' || rel END || ' the ' || b.word || ' ' || verbs.word AS core
  FROM nouns a, nouns b, verbs, (SELECT unnest(['that', 'who', '']) AS rel), others WHERE a.k < 6 AND b.k >= 2 AND a.word <> b.word)"""
_RELATIVIZER = "CASE WHEN rel = '' THEN 'zero' ELSE rel END"


@query(f"WITH {_BASE}, {_TR} SELECT core || ' ' || tail || '.' AS sentence, core AS pre_gap_text, 'the ' || n1 AS moved_np, verb, verb_type, {_RELATIVIZER} AS relativizer, 'animate' AS moved_np_animacy FROM tr")
def gen_transitivity_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Relative clauses of the documents' own nouns and verbs."""
    return _Words(spark, d).sentences(spark)


@query(
    f"WITH {_BASE}, {_TR} SELECT 'the ' || n1 AS moved_np, CASE WHEN rel <> '' THEN 'the ' || n2 END AS embedded_np, CASE WHEN rel <> '' THEN 2 END AS relativizer_at, count(*) AS n FROM tr GROUP BY ALL"
)
def np_extraction_of_words(spark: SparkSession, d: str) -> DataFrame:
    """The moved and the embedded noun phrase of each clause, and where its relativiser stands."""
    w, ws = _Words(spark, d), T.words("sentence")
    rows = w.sentences(spark).select(T.moved_np(ws, w.nouns).alias("moved_np"), T.embedded_np(ws, w.nouns).alias("embedded_np"), T.first_relativizer(ws).alias("relativizer_at"))
    return rows.groupBy("moved_np", "embedded_np", "relativizer_at").agg(F.count(F.lit(1)).alias("n"))


def _nine(got: DataFrame, *keys: str) -> DataFrame:
    return got.select(*keys, *(F.round(c, 9).alias(c) for c in got.columns if c not in keys))


@query(
    f"WITH {_BASE}, {_TR}, m AS (SELECT verb_type, verb, n1, count(*) AS n FROM tr GROUP BY ALL), r AS (SELECT verb_type, verb, {_prob('verb', 'n1')} AS mass, unnest(range(n)) FROM m), "
    "g AS (SELECT coalesce(verb_type, 'ALL') AS verb_type, coalesce(verb, 'ALL') AS verb, count(*) AS n, avg(mass) AS mean, median(mass) AS med FROM r GROUP BY ROLLUP(verb_type, verb)) "
    "SELECT verb_type, verb, n, round(mean, 9) AS mean, round(med, 9) AS median, CASE WHEN verb_type = 'ALL' THEN round((SELECT mean FROM g WHERE verb_type = 'transitive' AND verb = 'ALL') - (SELECT mean FROM g WHERE verb_type = 'intransitive' AND verb = 'ALL'), 9) END AS difference FROM g"
)
def transitivity_masses_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Mass of the moved noun after each verb, as the documents have it."""
    w = _Words(spark, d)
    return _nine(masses.transitivity_masses(w.sentences(spark), w.scorer()), "verb_type", "verb", "n")


@query(
    f"WITH {_BASE}, {_TR}, m AS (SELECT verb AS last, n1, CASE WHEN rel <> '' THEN n2 END AS n2, count(*) AS n FROM tr GROUP BY ALL), "
    f"h AS (SELECT last, noun, sqrt({_prob('last', chr(39) + 'the' + chr(39))} * {_prob(chr(39) + 'the' + chr(39), 'noun')}) AS g FROM (SELECT DISTINCT last FROM m), (SELECT word AS noun FROM nouns)), "
    "w AS (SELECT m.last, m.n1, m.n2, avg(h.g) AS vocab FROM m JOIN h ON h.last = m.last AND h.noun <> m.n1 AND h.noun IS DISTINCT FROM m.n2 GROUP BY ALL), "
    "r AS (SELECT a.g AS t, b.g AS e, w.vocab AS v, unnest(range(m.n)) FROM m JOIN h a ON a.last = m.last AND a.noun = m.n1 LEFT JOIN h b ON b.last = m.last AND b.noun = m.n2 JOIN w ON w.last = m.last AND w.n1 = m.n1 AND w.n2 IS NOT DISTINCT FROM m.n2) "
    "SELECT 'orc' AS structure, count(*) AS roi_count, round(avg(t), 9) AS target_mass, round(median(t), 9) AS target_mass_median, round(avg(e), 9) AS embedded_mass, round(median(e), 9) AS embedded_mass_median, "
    "round(avg(v), 9) AS vocab_mass, round(median(v), 9) AS vocab_mass_median, round(avg(t) - avg(v), 9) AS target_minus_vocab, round(avg(t) - avg(e), 9) AS target_minus_embedded, round(avg(e) - avg(v), 9) AS embedded_minus_vocab FROM r"
)
def moved_embedded_of_words(spark: SparkSession, d: str) -> DataFrame:
    """The moved, the embedded and the other noun phrases after the verb."""
    w = _Words(spark, d)
    return _nine(masses.moved_embedded_vocabulary(w.sentences(spark).select("sentence"), w.verbs, w.nouns, w.nouns, w.scorer()), "structure", "roi_count")


_TARGET = (
    "count(*) AS roi_count, round(avg(t), 9) AS target_mass, round(median(t), 9) AS target_mass_median, round(avg(h), 9) AS target_head_mass, round(median(h), 9) AS target_head_mass_median, "
    "round(avg(the), 9) AS the_mass, round(avg(c), 9) AS comparator_mass, round(median(c), 9) AS comparator_mass_median, round(avg(t) - avg(c), 9) AS target_minus_comparator"
)


@query(
    f"WITH {_BASE}, {_TR}, m AS (SELECT verb AS last, n1, count(*) AS n FROM tr GROUP BY ALL), o AS (SELECT last, avg({_prob('last', 'word')}) AS c FROM (SELECT DISTINCT last FROM m), others GROUP BY last), "
    f"x AS (SELECT last, n1, n, {_prob('last', chr(39) + 'the' + chr(39))} AS the, {_prob('last', 'n1')} AS h, {_prob(chr(39) + 'the' + chr(39), 'n1')} AS pn FROM m), "
    f"r AS (SELECT sqrt(the * pn) AS t, h, the, c, unnest(range(n)) FROM x JOIN o USING (last)) SELECT 'orc' AS structure, {_TARGET} FROM r"
)
def target_and_comparator_of_words(spark: SparkSession, d: str) -> DataFrame:
    """The moved noun phrase against other words that go on after the verb."""
    w = _Words(spark, d)
    contexts = masses.sites(w.sentences(spark), w.verbs).select("last", F.col("moved_np").alias("phrase"))
    return _nine(masses.target_and_comparator(contexts, w.others, w.scorer(), "orc"), "structure", "roi_count")


@query(
    rf"""WITH {_BASE}, t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[-1] AS last FROM conversations), l AS (SELECT last, count(*) AS n FROM t GROUP BY last),
pl AS (SELECT word AS noun FROM nouns UNION ALL SELECT word || 's' FROM nouns),
s AS (SELECT 'np' AS slot, last, n, sqrt({_prob('last', "'the'")} * {_prob("'the'", 'noun')}) AS g FROM l, pl UNION ALL SELECT 'vp', last, n, {_prob('last', 'word')} FROM l, verbs UNION ALL SELECT 'q', last, n, {_prob('last', "'?'")} FROM l),
e AS (SELECT slot, last, any_value(n) AS n, avg(g) AS g FROM s GROUP BY slot, last) SELECT slot, sum(n)::BIGINT AS n_items, round(sum(n * g) / sum(n), 9) AS mean_mass FROM e GROUP BY slot"""
)
def candidate_masses_of_turns(spark: SparkSession, d: str) -> DataFrame:
    """Noun phrases, verbs and the question mark after each turn of the conversations."""
    w = _Words(spark, d)
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item_id"), T.lower("text").alias("text"))
    cands = G.candidates(spark, "clause", {"adjectives": [], "nouns": w.nouns, "tails": w.verbs})
    asked = [r[0] for r in cands.select(F.explode(T.words("cand"))).distinct().collect()]  # the words of a fixed list
    got = evaluate.candidate_masses(turns, cands, w.scorer(*asked))
    return got.withColumn("mean_mass", F.round("mean_mass", 9))


_PREP = ", ".join(f"('{p}', {i})" for i, p in enumerate(L.PREPOSITIONS))
_NP = len(L.PREPOSITIONS)
#: Quadruplets: number, cells and the surprisal of what follows after the verb and after the filler.
_QUADS = f"""qd AS (SELECT (((a.k * 2 + b.k - 4) * {OTHERS} + o.k) * {_NP} + prep.k) * 15 + verbs.k * 5 + ob.k AS item, filler, gap, verbs.word AS verb, CASE WHEN filler = 1 THEN 'that' ELSE prep.p END AS first, CASE WHEN gap = 1 THEN o.word ELSE ob.word END AS post
  FROM nouns a, nouns b, others o, (VALUES {_PREP}) AS prep(p, k), verbs, nouns ob, (VALUES (1, 1), (0, 1), (1, 0), (0, 0)) AS f(filler, gap) WHERE a.k < 3 AND b.k BETWEEN 4 AND 5 AND verbs.k < 3 AND ob.k < 5),
d AS (SELECT DISTINCT verb, first, post FROM qd), ys AS (SELECT verb, first, post, -ln({_prob('verb', 'post')}) - ln({_prob('first', 'post')}) AS y FROM d), items AS (SELECT item, filler, gap, y, item % 3 AS checkpoint FROM qd JOIN ys USING (verb, first, post))"""


def _scored_quads(spark: SparkSession, d: str) -> DataFrame:
    w = _Words(spark, d)
    vocab = {"n1": w.nouns[:3], "n2": w.nouns[4:6], "tails": w.others, "objects": {v: w.nouns[:5] for v in w.verbs[:3]}}
    quads = G.factorial_clauses(spark, vocab).select(F.col("quadruplet_id").alias("item"), "filler", "gap", T.last_word("pre_gap_text").alias("verb"), F.col("filler_word").alias("first"), F.col("post_gap_text").alias("post"))
    # Cases that are alike are scored once: contexts and continuations are few, whatever the number of quadruplets.
    cases, scorer = stored(quads.select("verb", "first", "post").distinct(), "quad-cases"), w.scorer()
    asked = cases.select(F.explode(F.array("verb", "first")).alias("prev"), F.col("post").alias("token")).distinct()
    scores = stored(scorer.score(asked), "quad-scores")
    of = lambda c: scores.select(F.col("prev").alias(c), F.col("token").alias("post"), F.col("logp").alias(f"lp_{c}"))
    y = cases.join(of("verb"), ["verb", "post"]).join(of("first"), ["first", "post"]).select("verb", "first", "post", (-F.col("lp_verb") - F.col("lp_first")).alias("y"))
    return quads.join(y, ["verb", "first", "post"]).select("item", "filler", "gap", "y")


_CELLS = {(1, 1): "wh_gap", (1, 0): "wh_no_gap", (0, 1): "no_wh_gap", (0, 0): "no_wh_no_gap"}


@query(f"WITH {_BASE}, {_QUADS} SELECT filler, gap, count(*) AS n, count(DISTINCT item) AS n_items, round(avg(y), 6) AS surprisal, round(avg(y) / ln(2.0::DOUBLE), 6) AS surprisal_bits FROM items GROUP BY filler, gap")
def filler_gap_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Surprisal by cell of quadruplets of the documents' words."""
    rows = _scored_quads(spark, d).groupBy("filler", "gap").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("n_items"), F.avg("y").alias("surprisal"))
    return rows.select("filler", "gap", "n", "n_items", F.round("surprisal", 6).alias("surprisal"), F.round(scoring.bits(F.col("surprisal")), 6).alias("surprisal_bits"))


_BY_ITEM = f"w AS (SELECT checkpoint, item, {', '.join(f'avg(y) FILTER (filler = {f} AND gap = {g}) AS {n}' for (f, g), n in _CELLS.items())} FROM items GROUP BY checkpoint, item), s AS (SELECT *, (wh_no_gap - no_wh_no_gap) - (wh_gap - no_wh_gap) AS i FROM w)"


@query(f"WITH {_BASE}, {_QUADS}, {_BY_ITEM} SELECT checkpoint, count(*) AS n, round(avg(CASE WHEN i > 0 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(i), 6) AS mean_score, round(stddev_samp(i), 6) AS std_score FROM s GROUP BY checkpoint")
def factorial_of_words_by_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The interaction of filler and gap for three thirds of the items, as if they were checkpoints."""
    rows = _scored_quads(spark, d).withColumn("checkpoint", F.col("item") % 3)
    got = factorial.accuracy(rows, by=("checkpoint",))
    return got.select("checkpoint", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "mean_score", "std_score")))


@query(f"WITH {_BASE}, {_QUADS}, {_BY_ITEM} SELECT checkpoint, 4 * count(*) AS n_obs, count(*) AS n_items, round(avg((wh_gap + wh_no_gap - no_wh_gap - no_wh_no_gap) / 2), 6) AS b_filler, round(avg((wh_gap + no_wh_gap - wh_no_gap - no_wh_no_gap) / 2), 6) AS b_gap, round(-avg(i), 6) AS b_interaction, round(avg(i), 6) AS licensing FROM s GROUP BY checkpoint")
def filler_gap_models_of_words(spark: SparkSession, d: str) -> DataFrame:
    """A mixed model for each third; on whole items its estimates are the means of the contrasts."""
    got = mixed.fitted(_scored_quads(spark, d).withColumn("checkpoint", F.col("item") % 3), by=("checkpoint",))
    return got.select("checkpoint", "n_obs", "n_items", *(F.round(c, 6).alias(c) for c in ("b_filler", "b_gap", "b_interaction", "licensing")))


@query(
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark), a AS (SELECT item_id, ws, regexp_extract(ws[greatest(1, len(ws) // 2)], '\w+') AS anchor FROM w WHERE len(ws) > 0),
b AS (SELECT item_id, anchor, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM a WHERE anchor <> '')
SELECT item_id, anchor, min(i)::INT AS token_no FROM b WHERE regexp_matches(word, '(^|\W)' || anchor || '($|\W)') GROUP BY ALL"""
)
def anchors_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first token that holds the middle word of each text as a whole word."""
    ws = T.words("text")
    middle = F.try_element_at(ws, F.greatest(F.lit(1), F.floor(F.size(ws) / 2).cast("int")))
    texts = table(spark, d, "benchmark").select("item_id", "text", F.regexp_extract(middle, r"(\w+)", 1).alias("anchor")).where("anchor <> ''")
    return texts.select("item_id", "anchor").join(experiments.anchor_tokens(texts, "item_id", "text", "anchor", strict=False), "item_id")


@query(
    """WITH s AS (SELECT list_sort(list_distinct(list_concat([i * 50 FOR i IN range(1, 1 + n // 50)], [n]))) AS l, n FROM (SELECT count(*) AS n FROM documents)), e AS (SELECT unnest(l) AS step FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS step FROM documents) SELECT step, doc_id, round(greatest(0.2, pow(0.97::DOUBLE, step)), 9) AS temperature FROM e JOIN r USING (step)"""
)
def steps_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth document and the last, as evaluation steps, with a temperature that falls step by step."""
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    rows = numbered(docs, "doc_id", "place").select("doc_id", (F.col("place") + 1).alias("step"))
    due = rows.join(evaluate.evaluation_steps(spark, 50, n).select(F.col("step").cast("long").alias("step")), "step")
    falling = experiments.decay(spark, 1.0, 0.97, n + 1, 0.2).select(F.col("step").cast("long").alias("step"), "temperature")
    return due.join(falling, "step").select("step", "doc_id", F.round("temperature", 9).alias("temperature"))


@query("WITH a AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), b AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), g AS (SELECT source, lang, lr FROM a, b, (SELECT unnest([0.1, 0.01]::DOUBLE[]) AS lr)) SELECT row_number() OVER (ORDER BY source, lang, lr DESC) AS exp, source, lang, lr FROM g")
def grid_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """A run for each source, language and rate, numbered."""
    values = lambda c: [r[0] for r in table(spark, d, "documents").where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()]  # noqa: E731  (axes of a grid)
    return G.grid(spark, {"source": values("source"), "lang": values("lang"), "lr": [0.1, 0.01]}).withColumn("exp", F.col("exp").cast("long"))


@query(
    f"WITH {_BASE}, {_QUADS}, ones AS (SELECT DISTINCT item % 3 AS checkpoint, item, filler, gap, y FROM items WHERE gap = 1) "
    "SELECT checkpoint, round(avg(exp(-y)) FILTER (WHERE filler = 1) - avg(exp(-y)) FILTER (WHERE filler = 0), 9) AS difference FROM ones GROUP BY checkpoint"
)
def mass_difference_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Mean mass of what follows the gap with a filler less that without, for each third of the items."""
    p = F.exp(-F.col("y"))
    side = lambda f: F.avg(F.when(F.col("filler") == f, p))
    rows = _scored_quads(spark, d).where("gap = 1").groupBy((F.col("item") % 3).alias("checkpoint")).agg((side(1) - side(0)).alias("difference"))
    return rows.withColumn("difference", F.round("difference", 9))


_CHOICES = 4


@query(
    rf"""WITH {_BASE}, t AS (SELECT conv_id, turn, role, conv_id % {_CHOICES} AS gold, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[-1] AS last FROM conversations),
s AS (SELECT last, word, k, round(ln(sqrt({_prob("last", "'the'")} * {_prob("'the'", "word")})), 9) AS lp FROM (SELECT DISTINCT last FROM t WHERE last IS NOT NULL), nouns WHERE k < {_CHOICES}),
b AS (SELECT last, k FROM s QUALIFY row_number() OVER (PARTITION BY last ORDER BY lp DESC, word) = 1), r AS (SELECT role, CASE WHEN gold = k THEN 1 ELSE 0 END AS ok FROM t JOIN b USING (last))
SELECT coalesce(role, 'ALL') AS category, count(*) AS n, sum(ok)::BIGINT AS n_correct, round(avg(ok), 6) AS accuracy FROM r GROUP BY ROLLUP(role)"""
)
def cloze_of_turns(spark: SparkSession, d: str) -> DataFrame:
    """Which of four noun phrases goes on best after each turn, by the geometric mean of their words."""
    w = _Words(spark, d)
    turns = stored(
        table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item"), F.col("role").alias("category"), (F.col("conv_id") % _CHOICES).alias("gold"), T.last_word(T.lower("text")).alias("last")).where("last is not null"), "cloze-turns"
    )
    phrases = [f"the {n}" for n in w.nouns[:_CHOICES]]
    cases = turns.select("last").distinct().select("last", F.explode(G.options(phrases)).alias("phrase"))
    scored = turns.select("item", "last").join(masses.phrase_masses(cases, w.scorer()), "last").select("item", F.col("phrase").alias("cand"), F.round(F.ln("mass"), 9).alias("logp"))
    scores = F.map_from_entries(F.array_sort(F.array(*(F.struct(F.lit(p).alias("key"), (F.col("gold") == k).cast("double").alias("value")) for k, p in enumerate(phrases)))))
    got = evaluate.cloze_accuracy(turns.select("item", "category", scores.alias("target_scores")), scored)
    return got.withColumn("accuracy", F.round("accuracy", 6))


_MISFIT = f"""dd AS (SELECT 'The ' || a.word || ' ' || rel || ' the ' || b.word || ' ' || vb.word AS core, o.word AS tail, vb.word AS verb, a.word AS moved FROM nouns a, nouns b, verbs vb, (SELECT unnest(['that', 'who']) AS rel), others o
  WHERE a.k < 3 AND b.k >= 2 AND vb.k < 3 AND a.word <> b.word)"""


@query(
    f"WITH {_BASE}, {_MISFIT}, ct AS (SELECT word AS token, count(*) AS n FROM (SELECT unnest(ws) AS word FROM dw) GROUP BY word), t AS (SELECT sum(n) AS n_all, count(*) AS n_vocab FROM ct), "
    "e AS (SELECT core, tail, verb, moved, word AS object FROM dd, nouns WHERE k BETWEEN 3 AND 5), "
    "r AS (SELECT core, tail, verb, any_value((coalesce(m.n, 0) + 1.0::DOUBLE) / (n_all + n_vocab + 1)) AS p_moved, avg((coalesce(k.n, 0) + 1.0::DOUBLE) / (n_all + n_vocab + 1)) AS p_objects FROM e LEFT JOIN ct m ON m.token = moved LEFT JOIN ct k ON k.token = object, t GROUP BY core, tail, verb) "
    "SELECT coalesce(verb, 'ALL') AS verb, count(*) AS n, round(avg(p_moved), 9) AS moved_mean, round(avg(p_objects), 9) AS objects_mean, round(median(p_moved - p_objects), 9) AS difference_median FROM r GROUP BY ROLLUP(verb)"
)
def distractor_mass_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Mass of the moved noun against the mean of objects that would fit, by verb and over all."""
    w = _Words(spark, d)
    rows = G.distractors(spark, [(w.nouns[:3], {v: w.nouns[3:6] for v in w.verbs[:3]}, ["that", "who"], "animate", "no")], w.n2, w.others)
    scorer = scoring.UnigramScorer(w.words.select(F.explode("words").alias("token")), k=1.0)
    items = rows.select("sentence", T.last_word("pre_gap_text").alias("verb"), T.last_word("moved_np").alias("moved"), F.transform(T.split_multi("plausible_objects"), lambda o: T.last_word(o)).alias("objects"))
    words = items.select("moved").union(items.select(F.explode("objects"))).distinct().withColumnRenamed("moved", "token")
    masses_ = scorer.score(words).select("token", F.exp("logp").alias("p"))
    each = items.select("sentence", "verb", "moved", F.explode("objects").alias("object"))
    full = each.join(masses_.select(F.col("token").alias("moved"), F.col("p").alias("a")), "moved").join(masses_.select(F.col("token").alias("object"), F.col("p").alias("b")), "object")
    per = stored(full.groupBy("sentence", "verb").agg(F.first("a").alias("a"), F.avg("b").alias("b")), "distractor-masses")
    means = per.rollup("verb").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("moved_mean"), F.avg("b").alias("objects_mean"), F.grouping("verb").alias("_all"))
    means = means.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("verb")).alias("verb"), "n", "moved_mean", "objects_mean")
    levels = per.select(F.explode(F.array("verb", F.lit("ALL"))).alias("verb"), (F.col("a") - F.col("b")).alias("difference"))
    return _nine(means.join(quantiles(levels, "difference", {"difference_median": 0.5}, "verb"), "verb"), "verb", "n")


@query(
    f"WITH {_BASE}, f AS (SELECT CASE WHEN filler = 1 AND gap = 1 THEN 'wh_gap' WHEN filler = 1 THEN 'wh_no_gap' WHEN gap = 1 THEN 'no_wh_gap' ELSE 'no_wh_no_gap' END AS cell, CASE WHEN gap = 1 THEN o.word ELSE ob.word END AS post, "
    f"((((a.k * 2 + b.k - 4) * {OTHERS} + o.k) * {_NP} + prep.k) * 15 + verbs.k * 5 + ob.k) % 3 = 0 AS empty "
    f"FROM nouns a, nouns b, others o, (VALUES {_PREP}) AS prep(p, k), verbs, nouns ob, (VALUES (1, 1), (0, 1), (1, 0), (0, 0)) AS f(filler, gap) WHERE a.k < 3 AND b.k BETWEEN 4 AND 5 AND verbs.k < 3 AND ob.k < 5) "
    "SELECT cell, post || CASE WHEN empty THEN '.' ELSE '' END AS filled, count(*) AS n FROM f GROUP BY ALL"
)
def filled_gaps_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Condition labels, and what follows the gap from the sentence where it is empty."""
    w = _Words(spark, d)
    quads = G.factorial_clauses(spark, {"n1": w.nouns[:3], "n2": w.nouns[4:6], "tails": w.others, "objects": {v: w.nouns[:5] for v in w.verbs[:3]}})
    post = F.when(F.col("quadruplet_id") % 3 == 0, "").otherwise(F.col("post_gap_text"))
    rows = quads.select(factorial.cell_name().alias("cell"), factorial.post_gap(post, F.col("sentence"), F.col("pre_gap_text")).alias("filled"))
    return rows.groupBy("cell", "filled").agg(F.count(F.lit(1)).alias("n"))


_IRREGULAR = "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.IRREGULAR.items()) + " ELSE word || 's' END"


@query(rf"WITH w AS (SELECT DISTINCT lower(unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS word FROM conversations) SELECT word, {_IRREGULAR} AS plural, CASE WHEN word LIKE '%s' THEN word || 'es' ELSE word || 's' END AS third FROM w")
def regular_forms(spark: SparkSession, d: str) -> DataFrame:
    """Plurals and third persons of the words of the conversations."""
    words = table(spark, d, "conversations").select(F.explode(T.words("text")).alias("w")).select(T.lower("w").alias("word")).distinct()
    return words.select("word", T.pluralize("word").alias("plural"), T.third_person("word").alias("third"))
