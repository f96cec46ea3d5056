"""Sentence generators: products of word lists, filled into templates.

Slots that may stay empty have the empty word among their options, so each different sentence is made
once and nothing has to be deduplicated. The first lists are dealt out over the cluster; the rest
of the product is made by explode inside each task, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def options(words: Sequence) -> Column:
    return F.array(*map(F.lit, words))


def records(rows: Sequence[Sequence], names: Sequence[str]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))


def nouns(words: Sequence[str], noun: str, plural: str) -> Column:
    """Each noun as it is and in the plural, with a flag."""
    return F.array(*(F.struct((T.pluralize(F.lit(w)) if p else F.lit(w)).alias(noun), F.lit(p).alias(plural)) for w in words for p in (False, True)))


def product(spark: SparkSession, lists: dict[str, Column]) -> DataFrame:
    """All combinations of the lists' elements; structs become columns of their own."""
    df = spark.range(1).select()
    for k, (name, words) in enumerate(lists.items()):
        df = df.select("*", F.explode(words).alias(name))
        if k == min(1, len(lists) - 1):
            df = df.repartition(spark.sparkContext.defaultParallelism)
    flat = [f"{n}.*" if t.startswith("struct") else n for n, t in df.dtypes]
    return df.select(*flat)


def sentence(*parts: Column | str) -> Column:
    """The non-empty parts with single spaces; first letter upper case, the others lower case."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return T.capitalize(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in cols)))


def stop(c: Column, mark: str = ".") -> Column:
    return F.concat(c, F.lit(mark))


def allowed(verb: str, adverb: str) -> Column:
    ok = F.lit(True)
    for v, advs in L.ANY_ADVERB_BUT.items():
        ok = ok & ~((F.col(verb) == v) & F.col(adverb).isin(*advs))
    return ok


def _clause(spark: SparkSession) -> DataFrame:
    rows = product(
        spark,
        {
            "a": nouns(L.CLAUSE["n1"], "n1", "p1"), "b": nouns(L.CLAUSE["n2"], "n2", "p2"), "v": records(L.CLAUSE["verbs"], ("v_sg", "v_pl")),
            "adj1": options([*L.CLAUSE["adj1"], ""]), "adj2": options([*L.CLAUSE["adj2"], ""]), "adv": options([*L.CLAUSE["adverbs"], ""]),
        },
    )
    return rows.where(allowed("v_sg", "adv")).withColumn("verb", F.when(F.col("p2"), F.col("v_pl")).otherwise(F.col("v_sg")))


def relative_clauses(spark: SparkSession, seed: int | None = None) -> DataFrame:
    """Object relative clauses: n1, verb, p1, core; with a seed also sentence, the core with a tail drawn by number."""
    from .sampling import choose

    rows = _clause(spark).select("*", F.explode(options(["that", "who", ""])).alias("rel"))
    core = sentence(F.lit("The"), "adj1", "n1", "rel", F.lit("the"), "adj2", "n2", "adv", "verb")
    rows = rows.select("n1", "p1", F.col("v_sg").alias("lemma"), core.alias("core"))
    if seed is None:
        return rows
    tail = F.when(F.col("p1"), choose(L.CLAUSE["tail_plural"], "core", seed)).otherwise(choose(L.CLAUSE["tail_singular"], "core", seed))
    return rows.withColumn("sentence", stop(F.concat_ws(" ", "core", tail)))


def transitive_clauses(spark: SparkSession) -> DataFrame:
    """Subject, verb, object."""
    return _clause(spark).select("n1", F.col("v_sg").alias("lemma"), stop(sentence(F.lit("The"), "adj2", "n2", "adv", "verb", F.lit("the"), "adj1", "n1")).alias("sentence"))


def _question_lists() -> dict[str, Column]:
    return {"v": records(L.QUESTION_VERBS, ("base", "past", "ing")), "adj1": options([*L.CLAUSE["adj1"], ""]), "adj2": options([*L.CLAUSE["adj2"], ""]), "adv": options([*L.CLAUSE["adverbs"], ""])}


def _with_auxiliary(rows: DataFrame, plural: str) -> DataFrame:
    forms = F.array(
        F.struct(F.lit("did").alias("aux"), F.col("base").alias("form")),
        F.struct(F.when(F.col(plural), "do").otherwise("does").alias("aux"), F.col("base").alias("form")),
        F.struct(F.when(F.col(plural), "are").otherwise("is").alias("aux"), F.col("ing").alias("form")),
    )
    return rows.select("*", F.inline(forms))


def questions(spark: SparkSession) -> DataFrame:
    """Object questions with what, who, whom and which: kind, lemma, sentence.

    Verbs that need a living object take no `What`, and the second nouns as subjects only other verbs. In the first kind both adjectives stand
    before the subject.
    """
    animate = F.col("base").isin(*L.ANIMATE_ONLY)
    parts = []
    for words, plain in ((L.CLAUSE["n1"], True), (L.CLAUSE["n2"], False)):
        rows = _with_auxiliary(product(spark, {"n": nouns(words, "noun", "plural"), **_question_lists()}), "plural")
        rows = rows.select("*", F.explode(options(["What", "Who", "Whom"])).alias("wh")).where(~animate | ((F.col("wh") != "What") & F.lit(plain)))
        parts.append(rows.select(F.lit("wh").alias("kind"), F.col("base").alias("lemma"), stop(sentence("wh", "aux", F.lit("the"), "adj1", "adj2", "noun", "adv", "form"), "?").alias("sentence")))
    both = product(spark, {"a": nouns(L.CLAUSE["n1"], "n1", "p1"), "b": nouns(L.CLAUSE["n2"], "n2", "p2"), **_question_lists()})
    which = _with_auxiliary(both, "p1")
    parts.append(which.select(F.lit("which").alias("kind"), F.col("base").alias("lemma"), stop(sentence(F.lit("Which"), "adj2", "n2", "aux", F.lit("the"), "adj1", "n1", "adv", "form"), "?").alias("sentence")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def declaratives(spark: SparkSession) -> DataFrame:
    """Past, present and progressive: tense, lemma, sentence. The adverb of the progressive follows the auxiliary."""
    rows = product(spark, {"a": nouns(L.CLAUSE["n1"], "n1", "p1"), "b": nouns(L.CLAUSE["n2"], "n2", "p2"), **_question_lists()})
    forms = F.array(
        F.struct(F.lit("past").alias("tense"), F.lit("").alias("aux"), F.col("past").alias("form")),
        F.struct(F.lit("present").alias("tense"), F.lit("").alias("aux"), F.when(F.col("p1"), F.col("base")).otherwise(T.third_person("base")).alias("form")),
        F.struct(F.lit("prog").alias("tense"), F.when(F.col("p1"), "are").otherwise("is").alias("aux"), F.col("ing").alias("form")),
    )
    rows = rows.select("*", F.inline(forms))
    return rows.select("tense", F.col("base").alias("lemma"), stop(sentence(F.lit("The"), "adj1", "n1", "aux", "adv", "form", F.lit("the"), "adj2", "n2")).alias("sentence"))


def clause_pairs(spark: SparkSession) -> DataFrame:
    """Minimal pairs of subject and object relative clauses: lemma, src, orc."""
    rows = product(
        spark,
        {
            "a": nouns(L.CLAUSE["n1"], "n1", "p1"), "b": nouns(L.PAIR["n2"], "n2", "p2"), "v": records(L.PAIR["verbs"], ("v_sg", "v_pl")),
            "adj1": options(L.CLAUSE["adj1"]), "adj2": options(L.CLAUSE["adj2"]), "adv": options(L.CLAUSE["adverbs"]), "rel": options(["that", "who"]),
        },
    )
    tails = F.when(F.col("p1"), options(L.CLAUSE["tail_plural"])).otherwise(options(L.CLAUSE["tail_singular"]))
    rows = rows.where(allowed("v_sg", "adv")).select("*", F.explode(tails).alias("tail"))
    form = lambda p: F.when(F.col(p), F.col("v_pl")).otherwise(F.col("v_sg"))
    src = stop(sentence(F.lit("The"), "adj1", "n1", "rel", "adv", form("p1"), F.lit("the"), "adj2", "n2", "tail"))
    orc = stop(sentence(F.lit("The"), "adj1", "n1", "rel", F.lit("the"), "adj2", "n2", "adv", form("p2"), "tail"))
    return rows.select(F.col("v_sg").alias("lemma"), src.alias("src"), orc.alias("orc"))


def _numbered(words: Sequence[str]) -> list[tuple[int, str]]:
    return list(enumerate(words))


def _quads(rows: DataFrame, number: Column, pre: tuple[Column, Column], post: tuple[Column, Column], fillers: tuple[Column, Column], joint: str, mark: str) -> DataFrame:
    """The four conditions of each row: sentence, quadruplet_id, filler, gap, pre_gap_text, post_gap_text, filler_word."""
    cells = [
        F.struct(F.lit(f).alias("filler"), F.lit(g).alias("gap"), pre[1 - f].alias("pre_gap_text"), post[1 - g].alias("post_gap_text"), fillers[1 - f].alias("filler_word"))
        for g in (1, 0)
        for f in (1, 0)
    ]
    rows = rows.select(number.cast("int").alias("quadruplet_id"), F.inline(F.array(*cells)))
    space = F.when((F.col("gap") == 1) & F.lit(joint == ""), F.lit("")).otherwise(F.lit(" "))
    tail = F.when((F.col("gap") == 1) & F.lit(joint == ""), F.lit(mark)).otherwise(F.concat("post_gap_text", F.lit(mark)))
    return rows.select(F.concat("pre_gap_text", space, tail).alias("sentence"), "quadruplet_id", "filler", "gap", "pre_gap_text", "post_gap_text", "filler_word")


def factorial_clauses(spark: SparkSession, vocab: str | dict = "iv") -> DataFrame:
    """Quadruplets of relative clause or prepositional phrase, with gap or object. vocab names a vocabulary or is one: n1, n2, tails, and five objects for each verb."""
    v = L.FACTORIAL_CLAUSE[vocab] if isinstance(vocab, str) else vocab
    objects = [(i, verb, k, o) for i, (verb, os) in enumerate(v["objects"].items()) for k, o in enumerate(os)]
    rows = product(
        spark,
        {
            "a": records(_numbered(v["n1"]), ("i1", "n1")), "b": records(_numbered(v["n2"]), ("i2", "n2")), "c": records(_numbered(v["tails"]), ("i3", "tail")),
            "d": records(_numbered(L.PREPOSITIONS), ("i4", "prep")), "e": records(objects, ("i5", "verb", "i6", "object")),
        },
    )
    number = (((F.col("i1") * len(v["n2"]) + F.col("i2")) * len(v["tails"]) + F.col("i3")) * len(L.PREPOSITIONS) + F.col("i4")) * len(objects) + F.col("i5") * 5 + F.col("i6")
    pre = tuple(F.concat_ws(" ", F.lit("The"), "n1", w, F.lit("the"), "n2", "verb") for w in (F.lit("that"), F.col("prep")))
    return _quads(rows, number, pre, (F.col("tail"), F.col("object")), (F.lit("that"), F.col("prep")), " ", ".")


def factorial_questions(spark: SparkSession, vocab: str | dict = "iv") -> DataFrame:
    """Quadruplets of `What` or another first word, with gap or object. vocab names a vocabulary or is one: nouns, and five objects for each verb."""
    v = L.FACTORIAL_QUESTION[vocab] if isinstance(vocab, str) else vocab
    objects = [(i, verb, k, o) for i, (verb, os) in enumerate(v["objects"].items()) for k, o in enumerate(os)]
    rows = product(spark, {"a": records(_numbered(v["nouns"]), ("i1", "noun")), "b": records(objects, ("i2", "verb", "i4", "object")), "c": records(_numbered(L.NO_FILLERS), ("i3", "first"))})
    number = ((F.col("i1") * len(v["objects"]) + F.col("i2")) * len(L.NO_FILLERS) + F.col("i3")) * 5 + F.col("i4")
    pre = tuple(F.concat_ws(" ", w, F.lit("is the"), "noun", "verb") for w in (F.lit("What"), F.col("first")))
    return _quads(rows, number, pre, (F.lit("?"), F.col("object")), (F.lit("What"), F.col("first")), "", "?")


def transitivity(
    spark: SparkSession, n1: Sequence[str] = L.ANIMATE_1, n2: Sequence[str] = L.ANIMATE_2, transitive: Sequence[str] = L.TRANSITIVE, intransitive: Sequence[str] = L.INTRANSITIVE, tails: Sequence[str] = L.TAILS
) -> DataFrame:
    """Relative clauses with a verb that takes an object or one that doesn't."""
    verbs = [(v, "transitive") for v in transitive] + [(v, "intransitive") for v in intransitive]
    rows = product(spark, {"n1": options(n1), "n2": options(n2), "v": records(verbs, ("verb", "verb_type")), "rel": options(["that", "who", ""]), "tail": options(tails)})
    core = sentence(F.lit("The"), "n1", "rel", F.lit("the"), "n2", "verb")
    return rows.where("n1 <> n2").select(
        stop(F.concat_ws(" ", core, "tail")).alias("sentence"), core.alias("pre_gap_text"), F.concat(F.lit("the "), "n1").alias("moved_np"), "verb", "verb_type",
        F.when(F.col("rel") == "", "zero").otherwise(F.col("rel")).alias("relativizer"), F.lit("animate").alias("moved_np_animacy"),
    )


#: Moved nouns, objects that fit each verb, relativisers, whether the nouns are animate, whether the verbs expect that.
MISFITS = ((L.ANIMATE_1, L.INANIMATE_OBJECTS, ["that", "who"], "animate", "no"), (L.INANIMATE_1, L.ANIMATE_OBJECTS, ["that"], "inanimate", "yes"))


def distractors(spark: SparkSession, misfits: Sequence[tuple] = MISFITS, n2: Sequence[str] = L.ANIMATE_2, tails: Sequence[str] = L.TAILS) -> DataFrame:
    """Relative clauses whose verb doesn't fit the moved noun, with the objects that would."""
    parts = []
    for n1, objects, rels, animacy, expects in misfits:
        verbs = [(v, "|".join(f"the {o}" for o in os)) for v, os in objects.items()]
        rows = product(spark, {"n1": options(n1), "n2": options(n2), "v": records(verbs, ("verb", "plausible_objects")), "rel": options(rels), "tail": options(tails)})
        core = sentence(F.lit("The"), "n1", "rel", F.lit("the"), "n2", "verb")
        parts.append(
            rows.where("n1 <> n2").select(
                stop(F.concat_ws(" ", core, "tail")).alias("sentence"), core.alias("pre_gap_text"), F.concat(F.lit("the "), "n1").alias("moved_np"), "plausible_objects",
                F.lit(animacy).alias("moved_np_animacy"), F.lit(expects).alias("verb_expects_animate"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def candidates(spark: SparkSession, kind: str = "clause", vocab: str | dict = "iv") -> DataFrame:
    """The candidate continuations of a context: slot (np, vp, q) and cand. vocab names a vocabulary or is one: adjectives, nouns, and tails (clause) or forms of verbs."""
    v = (L.CANDIDATES_CLAUSE if kind == "clause" else L.CANDIDATES_QUESTION)[vocab] if isinstance(vocab, str) else vocab
    np_ = product(spark, {"adj": options(["", *v["adjectives"]]), "n": nouns(v["nouns"], "noun", "plural")})
    np_ = np_.select(F.lit("np").alias("slot"), F.concat_ws(" ", F.lit("the"), F.nullif(F.col("adj"), F.lit("")), "noun").alias("cand"))
    tails = v["tails"] if kind == "clause" else [f for b, p, i in v["verbs"] for f in (b, p, i, f"did {b}", f"does {b}", f"do {b}", f"is {i}", f"are {i}")]
    rest = spark.range(1).select(F.explode(F.array_union(records([("vp", t) for t in tails], ("slot", "cand")), records([("q", "?")], ("slot", "cand")))).alias("c")).select("c.*")
    return np_.unionByName(rest)


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All points of a grid of settings, numbered from 1 in order of the axes."""
    df, number = spark.range(1).select(), F.lit(0)
    for name, values in axes.items():
        df = df.select("*", F.posexplode(options(values)).alias(f"_{name}", name))
        number = number * len(values) + F.col(f"_{name}")
    return df.select((number + 1).alias("exp"), *axes)


def without_repeats(sentences: DataFrame, words: Sequence[str], column: str = "sentence") -> DataFrame:
    """The sentences in which none of the words stands twice."""
    bare = F.transform(T.words(column), T.normalize_word)
    return sentences.where(~T.repeated(bare, words))
