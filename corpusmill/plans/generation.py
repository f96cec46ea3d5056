"""The generators as queries. Their SQL makes the sentences from the same word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import generate as G
from .base import number, table
from .catalog import query


def _list(words: list) -> str:
    return "[" + ", ".join("'" + w + "'" if isinstance(w, str) else str(w) for w in words) + "]"


def _un(alias: str, words: list[str]) -> str:
    return f"(SELECT unnest({_list(words)}) AS {alias})"


def _rows(names: tuple[str, ...], rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows) + f") AS t_{names[0]}({', '.join(names)})"


def _nouns(names: tuple[str, str], words: list[str]) -> str:
    return _rows(names, [(w if not p else T.IRREGULAR.get(w, w + "s"), p) for w in words for p in (0, 1)])


def _join(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({p}, '')" for p in parts) + ")"


def _cap(s: str) -> str:
    return f"upper(substr({s}, 1, 1)) || lower(substr({s}, 2))"


_A, _B = _nouns(("n1", "p1"), L.CLAUSE["n1"]), _nouns(("n2", "p2"), L.CLAUSE["n2"])
_MODS = f"{_un('adj1', [*L.CLAUSE['adj1'], ''])}, {_un('adj2', [*L.CLAUSE['adj2'], ''])}, {_un('adv', [*L.CLAUSE['adverbs'], ''])}"
_CLAUSE = f"FROM {_A}, {_B}, {_rows(('v_sg', 'v_pl'), L.CLAUSE['verbs'])}, {_MODS}"
_OK = "NOT (v_sg IN ('follows', 'greets') AND adv = 'secretly')"
_VERB = "CASE WHEN p2 = 1 THEN v_pl ELSE v_sg END"


def _summary(df: DataFrame, by: str, column: str = "sentence") -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(column)).alias("n_chars"), F.min(column).alias("least"), F.max(column).alias("most"), F.sum(F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")).alias("digest")
    )


def _sum_sql(by: str, column: str = "sentence") -> str:
    return f"{by}, count(*) AS n, sum(length({column}))::BIGINT AS n_chars, min({column}) AS least, max({column}) AS most, sum(CAST('0x' || substr(md5({column}), 1, 8) AS BIGINT))::BIGINT AS digest"


_CORE = _join("'The'", "adj1", "n1", "rel", "'the'", "adj2", "n2", "adv", _VERB)
_TAILS = f"CASE WHEN p1 = 1 THEN {_list(L.CLAUSE['tail_plural'])} ELSE {_list(L.CLAUSE['tail_singular'])} END"


@query(f"WITH s AS (SELECT DISTINCT v_sg AS lemma, p1, {_cap(_CORE)} AS core {_CLAUSE}, {_un('rel', ['that', 'who', ''])} WHERE {_OK}), f AS (SELECT lemma, core || ' ' || ({_TAILS})[CAST('0x' || substr(md5('42|' || core), 1, 8) AS BIGINT) % 6 + 1] || '.' AS sentence FROM s) SELECT {_sum_sql('lemma')} FROM f GROUP BY lemma")
def gen_orc(spark: SparkSession, d: str) -> DataFrame:
    return _summary(G.relative_clauses(spark, seed=42), "lemma")


@query(f"WITH s AS (SELECT DISTINCT v_sg AS lemma, {_cap(_join(chr(39) + 'The' + chr(39), 'adj2', 'n2', 'adv', _VERB, chr(39) + 'the' + chr(39), 'adj1', 'n1'))} || '.' AS sentence {_CLAUSE} WHERE {_OK}) SELECT {_sum_sql('lemma')} FROM s GROUP BY lemma")
def gen_svo(spark: SparkSession, d: str) -> DataFrame:
    return _summary(G.transitive_clauses(spark), "lemma")


_Q = f"{_rows(('base', 'past', 'ing'), L.QUESTION_VERBS)}, {_MODS}, {_rows(('aux_sg', 'aux_pl', 'is_ing'), [('did', 'did', 0), ('does', 'do', 0), ('is', 'are', 1)])}"
_FORM = "CASE WHEN is_ing = 1 THEN ing ELSE base END"


def _wh(nouns: str, plural: str, n: str, first: str) -> str:
    sentence = _cap(_join("wh", f"CASE WHEN {plural} = 1 THEN aux_pl ELSE aux_sg END", "'the'", "adj1", "adj2", n, "adv", _FORM))
    return f"SELECT 'wh' AS kind, {sentence} || '?' AS sentence FROM {nouns}, {_Q}, {_un('wh', ['What', 'Who', 'Whom'])} WHERE base <> 'greet' OR (wh <> 'What' AND {first})"


_WHICH = _cap(_join("'Which'", "adj2", "n2", "CASE WHEN p1 = 1 THEN aux_pl ELSE aux_sg END", "'the'", "adj1", "n1", "adv", _FORM))


@query(f"WITH s AS ({_wh(_A, 'p1', 'n1', 'TRUE')} UNION {_wh(_B, 'p2', 'n2', 'FALSE')} UNION SELECT 'which', {_WHICH} || '?' FROM {_A}, {_B}, {_Q}) SELECT {_sum_sql('kind')} FROM s GROUP BY kind")
def gen_wh(spark: SparkSession, d: str) -> DataFrame:
    return _summary(G.questions(spark), "kind")


_DECL = _cap(_join("'The'", "adj1", "n1", "CASE WHEN tense = 'prog' THEN CASE WHEN p1 = 1 THEN 'are' ELSE 'is' END ELSE '' END", "adv", "CASE tense WHEN 'past' THEN past WHEN 'prog' THEN ing ELSE CASE WHEN p1 = 1 THEN base ELSE base || 's' END END", "'the'", "adj2", "n2"))


@query(f"WITH s AS (SELECT DISTINCT tense, {_DECL} || '.' AS sentence FROM {_A}, {_B}, {_rows(('base', 'past', 'ing'), L.QUESTION_VERBS)}, {_MODS}, {_un('tense', ['past', 'present', 'prog'])}) SELECT {_sum_sql('tense')} FROM s GROUP BY tense")
def gen_declarative(spark: SparkSession, d: str) -> DataFrame:
    return _summary(G.declaratives(spark), "tense")


_PAIRS = f"FROM {_A}, {_nouns(('n2', 'p2'), L.PAIR['n2'])}, {_rows(('v_sg', 'v_pl'), L.PAIR['verbs'])}, {_un('adj1', L.CLAUSE['adj1'])}, {_un('adj2', L.CLAUSE['adj2'])}, {_un('adv', L.CLAUSE['adverbs'])}, {_un('rel', ['that', 'who'])}"
_SRC = _cap(_join("'The'", "adj1", "n1", "rel", "adv", "CASE WHEN p1 = 1 THEN v_pl ELSE v_sg END", "'the'", "adj2", "n2", "tail"))
_ORC = _cap(_join("'The'", "adj1", "n1", "rel", "'the'", "adj2", "n2", "adv", _VERB, "tail"))


@query(f"WITH t AS (SELECT *, unnest({_TAILS}) AS tail {_PAIRS} WHERE {_OK}), s AS (SELECT v_sg AS lemma, {_SRC} || '.' || '|' || {_ORC} || '.' AS pair FROM t) SELECT {_sum_sql('lemma', 'pair')} FROM s GROUP BY lemma")
def gen_src_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _summary(G.clause_pairs(spark).withColumn("pair", F.concat_ws("|", "src", "orc")), "lemma", "pair")


def _quads_sql(number: str, source: str, filler_pre: str, other_pre: str, gap_sentence: str, gap_text: str, mark: str, words: tuple[str, str]) -> str:
    return (
        f"WITH q AS (SELECT {number} AS quadruplet_id, * FROM {source}), c AS (SELECT *, CASE WHEN filler = 1 THEN {filler_pre} ELSE {other_pre} END AS pre_gap_text, CASE WHEN filler = 1 THEN {words[0]} ELSE {words[1]} END AS filler_word "
        f"FROM q, (VALUES (1, 1), (0, 1), (1, 0), (0, 0)) AS f(filler, gap)) SELECT quadruplet_id::INTEGER AS quadruplet_id, filler, gap, pre_gap_text, CASE WHEN gap = 1 THEN {gap_text} ELSE object END AS post_gap_text, filler_word, "
        f"CASE WHEN gap = 1 THEN {gap_sentence} ELSE pre_gap_text || ' ' || object || '{mark}' END AS sentence FROM c"
    )


def _clause_quads(vocab: str) -> str:
    v = L.FACTORIAL_CLAUSE[vocab]
    objects = [(i, verb, k, o) for i, (verb, os) in enumerate(v["objects"].items()) for k, o in enumerate(os)]
    source = ", ".join([_rows(("i1", "n1"), list(enumerate(v["n1"]))), _rows(("i2", "n2"), list(enumerate(v["n2"]))), _rows(("i3", "tail"), list(enumerate(v["tails"]))), _rows(("i4", "prep"), list(enumerate(L.PREPOSITIONS))), _rows(("i5", "verb", "i6", "object"), objects)])
    return _quads_sql("(((i1 * 5 + i2) * 5 + i3) * 4 + i4) * 25 + i5 * 5 + i6", source, "'The ' || n1 || ' that the ' || n2 || ' ' || verb", "'The ' || n1 || ' ' || prep || ' the ' || n2 || ' ' || verb", "pre_gap_text || ' ' || tail || '.'", "tail", ".", ("'that'", "prep"))


def _question_quads(vocab: str) -> str:
    v = L.FACTORIAL_QUESTION[vocab]
    objects = [(i, verb, k, o) for i, (verb, os) in enumerate(v["objects"].items()) for k, o in enumerate(os)]
    source = ", ".join([_rows(("i1", "noun"), list(enumerate(v["nouns"]))), _rows(("i2", "verb", "i4", "object"), objects), _rows(("i3", "first"), list(enumerate(L.NO_FILLERS)))])
    return _quads_sql("((i1 * 5 + i2) * 5 + i3) * 5 + i4", source, "'What is the ' || noun || ' ' || verb", "first || ' is the ' || noun || ' ' || verb", "pre_gap_text || '?'", "'?'", "?", ("'What'", "first"))


for _v in ("iv", "oov"):
    query(_clause_quads(_v), f"gen_factorial_orc_{_v}")(lambda spark, d, v=_v: G.factorial_clauses(spark, v))
    query(_question_quads(_v), f"gen_factorial_wh_{_v}")(lambda spark, d, v=_v: G.factorial_questions(spark, v))

_T = f"FROM {_un('n1', L.ANIMATE_1)}, {_un('n2', L.ANIMATE_2)}, {_rows(('verb', 'verb_type'), [(v, 'transitive') for v in L.TRANSITIVE] + [(v, 'intransitive') for v in L.INTRANSITIVE])}, {_un('rel', ['that', 'who', ''])}, {_un('tail', L.TAILS)}"
_TC = _cap(_join("'The'", "n1", "rel", "'the'", "n2", "verb"))


@query(f"SELECT {_TC} || ' ' || tail || '.' AS sentence, {_TC} AS pre_gap_text, 'the ' || n1 AS moved_np, verb, verb_type, CASE WHEN rel = '' THEN 'zero' ELSE rel END AS relativizer, 'animate' AS moved_np_animacy {_T} WHERE n1 <> n2")
def gen_transitivity(spark: SparkSession, d: str) -> DataFrame:
    return G.transitivity(spark)


def _distract(n1: list[str], objects: dict, rels: list[str], animacy: str, expects: str) -> str:
    verbs = _rows(("verb", "plausible_objects"), [(v, "|".join(f"the {o}" for o in os)) for v, os in objects.items()])
    return f"SELECT {_TC} || ' ' || tail || '.' AS sentence, {_TC} AS pre_gap_text, 'the ' || n1 AS moved_np, plausible_objects, '{animacy}' AS moved_np_animacy, '{expects}' AS verb_expects_animate FROM {_un('n1', n1)}, {_un('n2', L.ANIMATE_2)}, {verbs}, {_un('rel', rels)}, {_un('tail', L.TAILS)} WHERE n1 <> n2"


@query(_distract(L.ANIMATE_1, L.INANIMATE_OBJECTS, ["that", "who"], "animate", "no") + " UNION ALL " + _distract(L.INANIMATE_1, L.ANIMATE_OBJECTS, ["that"], "inanimate", "yes"))
def gen_distractors(spark: SparkSession, d: str) -> DataFrame:
    return G.distractors(spark)


def _candidates(kind: str, vocab: str) -> str:
    v = (L.CANDIDATES_CLAUSE if kind == "clause" else L.CANDIDATES_QUESTION)[vocab]
    tails = v["tails"] if kind == "clause" else list(dict.fromkeys(f for b, p, i in v["verbs"] for f in (b, p, i, f"did {b}", f"does {b}", f"do {b}", f"is {i}", f"are {i}")))
    np_ = f"SELECT '{kind}' AS kind, '{vocab}' AS vocab, 'np' AS slot, {_join(chr(39) + 'the' + chr(39), 'adj', 'noun')} AS cand FROM {_un('adj', ['', *v['adjectives']])}, {_nouns(('noun', 'p'), v['nouns'])}"
    return f"{np_} UNION ALL SELECT '{kind}', '{vocab}', 'vp', unnest({_list(tails)}) UNION ALL SELECT '{kind}', '{vocab}', 'q', '?'"


_KINDS = [(k, v) for k in ("clause", "question") for v in ("iv", "oov")]


@query(" UNION ALL ".join(_candidates(k, v) for k, v in _KINDS))
def gen_candidates(spark: SparkSession, d: str) -> DataFrame:
    parts = [G.candidates(spark, k, v).select(F.lit(k).alias("kind"), F.lit(v).alias("vocab"), "slot", "cand") for k, v in _KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _grid(axes: dict[str, list]) -> str:
    number, sources = "0", []
    for name, values in axes.items():
        number = f"({number}) * {len(values)} + i_{name}"
        sources.append(_rows((f"i_{name}", name), list(enumerate(values))))
    return f"SELECT CAST({number} + 1 AS BIGINT) AS exp, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in axes)} FROM " + ", ".join(sources)


@query(_grid(L.GRID))
def hyper_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = G.grid(spark, L.GRID)
    return number(rows.select("exp", *(F.col(n).cast("double") for n in L.GRID)), "exp")


@query(_grid(L.SEARCH_GRID))
def search_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = G.grid(spark, L.SEARCH_GRID)
    return number(rows.select("exp", *(F.col(n).cast("double") for n in L.SEARCH_GRID)), "exp")


@query("SELECT doc_id, 'exp-' || lpad(doc_id::VARCHAR, 3, '0') AS name, replace('lr' || (doc_id % 7) || '.5_wd0.01', '.', 'p') AS encoded FROM documents")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k, F.concat(F.lit("exp-"), F.lpad(k.cast("string"), 3, "0")).alias("name"), T.encode_name(F.concat(F.lit("lr"), (k % 7).cast("string"), F.lit(".5_wd0.01"))).alias("encoded")
    )
