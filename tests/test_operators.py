"""Properties, golden sizes and errors of the operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import stats
from corpusmill.functions import text as T
from corpusmill.operators import corpus, evaluate, factorial, generate, mixture, order, sampling, scoring, tokens


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "size"),
    [
        (lambda s: generate.relative_clauses(s), 367_200), (lambda s: generate.transitive_clauses(s), 122_400), (lambda s: generate.questions(s), 574_560),
        (lambda s: generate.declaratives(s), 378_000), (lambda s: generate.clause_pairs(s), 840_000), (lambda s: generate.factorial_clauses(s), 50_000),
        (lambda s: generate.factorial_questions(s, "oov"), 5_000), (lambda s: generate.transitivity(s), 23_808), (lambda s: generate.distractors(s), 8_928 + 6_144),
    ],
)
def test_generator_sizes(spark, make, size):
    assert make(spark).count() == size


@pytest.mark.parametrize(("kind", "vocab", "sizes"), [("clause", "iv", (220, 12, 1)), ("clause", "oov", (20, 10, 1)), ("question", "iv", (220, 40, 1)), ("question", "oov", (20, 40, 1))])
def test_candidate_sizes(spark, kind, vocab, sizes):
    rows = {r["slot"]: r["count"] for r in generate.candidates(spark, kind, vocab).groupBy("slot").count().collect()}
    if kind == "question" and vocab == "oov" or kind == "question":
        assert (rows["np"], rows["q"]) == (sizes[0], 1)
        assert rows["vp"] <= sizes[1]
    else:
        assert (rows["np"], rows["vp"], rows["q"]) == sizes


def test_sentences_are_distinct(spark):
    rows = generate.questions(spark)
    assert rows.select("sentence").distinct().count() == rows.count()


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.strip, "\t a b  ", "a b"), (T.squeeze, " a\t\tb  c ", "a b c"), (T.capitalize, "the Boy SEES", "The boy sees"), (T.capitalize_first, "the Boy", "The Boy"),
        (T.preprocess, " a <unk>b <eos> ", "a b <|endoftext|>"), (T.preprocess, "a", "a <|endoftext|>"), (T.before_tokens, "a <unk>", "a [MISSING]<|endoftext|>"), (T.before_tokens, "a<|endoftext|>", "a<|endoftext|>"),
        (T.format_eos, "hi there", "Hi there. <eos>"), (T.normalize_word, "(The),", "the"), (T.normalize_word_right, "(The),", "(the)"), (T.pluralize, "child", "children"), (T.pluralize, "boy", "boys"),
        (T.pluralize_long, "city", "cities"), (T.pluralize_long, "fox", "foxes"), (T.pluralize_long, "goose", "geese"), (T.pluralize_long, "boy", "boys"), (T.third_person, "see", "sees"), (T.third_person, "pass", "passes"),
        (T.strip_article, "The boy", "boy"), (T.before_question, "What? Who ? x", "What? Who"), (T.before_question, " none ", "none"), (T.encode_name, "0.01", "0p01"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f(F.lit(value))) == want


def test_text_with_parameters(spark):
    through = lambda s: one(spark, T.through_phrase(F.lit(s), ["see", "see off", "saw"]))
    assert through("He will See off her") == "He will See off"
    assert through("No seesaw here ") == "No seesaw here"
    ws = lambda s: T.words(F.lit(s))
    assert one(spark, T.moved_np(ws("The big boy that the girl sees."), ["boy", "girl"])) == "the big boy"
    assert one(spark, T.moved_np(ws("A boy"), ["boy"])) is None
    assert one(spark, T.moved_np(ws("The big that boy"), ["boy"])) is None
    assert one(spark, T.embedded_np(ws("The boy which the girl sees"), ["girl"])) == "the girl"
    assert one(spark, T.embedded_np(ws("The boy that"), ["girl"])) is None
    assert one(spark, T.replace_in_order(F.lit("run-PAST try-3PRES see-ing-"), [("run-PAST", "ran"), ("-3PRES", "s")])) == "ran trys seeing"
    assert one(spark, T.whole_word_positions(F.lit("at a cat at"), "at")) == [0, 9]
    assert one(spark, T.split_multi(F.lit("the a| |the b|"))) == ["the a", "the b"]
    assert one(spark, T.sentences(F.lit("A b. C! D"))) == ["A b.", "C!", "D"]
    assert one(spark, T.repeated(ws("a b a"), ["a"])) and not one(spark, T.repeated(ws("a b b"), ["a"]))
    assert one(spark, T.last_word(F.lit("a b c"), 2)) == "b"
    assert one(spark, T.mask_labels(F.array(F.lit(1), F.lit(7)), 7)) == [1, -100]


def test_numbers_and_sums_over_ranges(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = order.running_sum(order.numbered(rows, "k", "n", ranges=7), "k", "v", "s", ranges=5).orderBy("k").collect()
    total = 0
    for i, r in enumerate(got):
        assert (r["n"], r["s"]) == (i, total)
        total += r["v"]
    same_key = spark.range(10).select(F.lit(1).alias("k"), "id")
    assert sorted(r["n"] for r in order.numbered(same_key, "k", "n", ("id",)).collect()) == list(range(10))
    assert order.numbered(rows.where("false"), "k", "n").count() == 0


def test_augment_sizes_and_errors(spark):
    base, target, fill = (spark.range(a, b).withColumnRenamed("id", "pos") for a, b in ((0, 100), (1000, 1040), (2000, 2060)))
    rows = {r["origin"]: r["count"] for r in sampling.augment(base, target, fill, 50, 0.01, 0.2, "pos", 1).groupBy("origin").count().collect()}
    assert rows == {"base": 100, "target": 29, "filler": 21}  # round(.19 * 100 + .2 * 50)
    rows = {r["origin"]: r["count"] for r in sampling.augment(base, target, fill, 50, 0.5, 0.1, "pos", 1).groupBy("origin").count().collect()}
    assert rows == {"base": 100, "filler": 50}
    with pytest.raises(ValueError):
        sampling.augment(base, target, fill.limit(3), 50, 0.01, 0.2, "pos", 1)


def test_replacements_keep_the_size(spark):
    base, a, b = (spark.range(x, y).withColumnRenamed("id", "pos") for x, y in ((0, 500), (1000, 1400), (2000, 2400)))
    exact = sampling.replace_exact(base, a, 0.1, 0.3, "pos", 3)
    assert exact.count() == 500 and exact.where("origin = 'target'").count() == int(500 * 0.2 / 0.9)
    assert sampling.replace_two(base, a, b, (0.1, 0.1), (0.2, 0.1), "pos", 3).count() == 500
    with pytest.raises(ValueError):
        sampling.replace_exact(base, a.limit(2), 0.1, 0.9, "pos", 3)


def test_splits_are_disjoint_and_whole(spark):
    rows = spark.range(300).select((F.col("id") % 30).alias("g"), "id")
    got = sampling.split_groups(rows, "g", 0.8, 5)
    assert got.count() == 300
    per = got.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1")
    assert per.count() == 0 and got.where("split = 'train'").select("g").distinct().count() == 24
    with pytest.raises(ValueError):
        sampling.split_test_final(rows, 301, 5, "id", 1)
    again = sampling.sample(rows, 20, "id", 9)
    assert [r["id"] for r in again.collect()] == [r["id"] for r in sampling.sample(rows.repartition(7), 20, "id", 9).collect()]
    with pytest.raises(ValueError):
        sampling.sample(rows, 301, "id", 1, short="error")


def test_rejection_ends(spark):
    make = lambda start, size: spark.range(start, start + size).select(F.col("id").alias("number"), (F.col("id") % 10).alias("x"))
    assert sampling.rejected_until(make, F.col("x") > 4, 5, "x", 8).count() == 5
    with pytest.raises(ValueError):
        sampling.rejected_until(make, F.col("x") > 4, 6, "x", 8, rounds=3)


def test_hold_out_sees_through_the_end_mark(spark):
    lines = lambda rows: spark.createDataFrame(list(enumerate(rows)), "pos long, text string")
    train = lines(["a b. <|endoftext|>", "c."])
    got = corpus.hold_out(lines(["a b.", "c.", " d. ", "d."]), train).collect()
    assert [r["text"] for r in got] == [" d. "]
    assert {r["text"] for r in corpus.hold_out(lines(["a b.", "c."]), train, exact=True).collect()} == {"a b."}


def test_blocks_conserve_tokens(spark):
    rows = spark.range(40).select(F.col("id").alias("pos"), F.array_repeat(F.col("id").cast("string"), (F.col("id") % 6).cast("int")).alias("words"))
    stream = tokens.positions(rows)
    n = stream.count()
    assert [r["g"] for r in stream.orderBy("g").collect()] == list(range(n))
    placed = tokens.placed(rows)
    got = tokens.packed(placed, 16, masked="7").collect()
    assert len(got) == n // 16 and all(len(r["input_ids"]) == 16 for r in got)
    assert all((i == "7") == (x is None) for r in got for i, x in zip(r["input_ids"], r["labels"]))
    assert tokens.packed(placed, n + 1).count() == 0 and tokens.packed(placed, n).count() == 1
    lanes = tokens.lanes(stream, 3).groupBy("lane").count().collect()
    assert {r["count"] for r in lanes} == {n // 3}


def test_mixture_follows_the_weights(spark):
    assert mixture.normalized({"a": 1, "b": 0, "c": 3}) == [("a", 0.25), ("c", 1.0)]
    with pytest.raises(ValueError):
        mixture.normalized({"a": 0})
    docs = spark.range(6).select(F.when(F.col("id") < 3, "a").otherwise("b").alias("source"), F.col("id").alias("pos"))
    got = {r["source"]: r["count"] for r in mixture.per_document(docs, {"a": 3, "b": 1}, 2000, 1).groupBy("source").count().collect()}
    assert abs(got["a"] / 2000 - 0.75) < 0.05
    seq = mixture.cycled(docs.select(F.col("pos").alias("at")), "at", 14)
    assert sorted((r["seq"], r["at"]) for r in seq.collect()) == [(i, i % 6) for i in range(14)]


def test_mixed_model_matches_least_squares(spark):
    """Balanced cells: the estimates are contrasts of cell means; standard errors from the two strata."""
    import numpy as np

    rng = np.random.default_rng(0)
    n, rows = 40, []
    for i in range(n):
        u = rng.normal() * 2
        for f in (0, 1):
            for g in (0, 1):
                rows.append((i, f, g, float(3 + u + f - 0.5 * g + 0.7 * f * g + rng.normal())))
    rows.append((99, 1, 1, 5.0))
    r = factorial.mixed_model(spark.createDataFrame(rows, "item long, filler int, gap int, y double")).first()
    y = np.array([x[3] for x in rows[:-1]]).reshape(n, 2, 2)
    c = y.mean(axis=0)
    assert r["n_items"] == n and r["n_dropped"] == 1
    assert math.isclose(r["b_interaction"], c[1, 1] - c[1, 0] - c[0, 1] + c[0, 0], abs_tol=1e-9)
    assert math.isclose(r["licensing"], -r["b_interaction"])
    resid = y - y.mean(axis=(1, 2), keepdims=True) - c + y.mean()
    assert math.isclose(r["sigma2"], (resid**2).sum() / (3 * (n - 1)), rel_tol=1e-9)
    ci = factorial.within_item_interval(spark.createDataFrame(rows, "item long, filler int, gap int, y double")).first()
    per = (y[:, 1, 0] - y[:, 0, 0]) - (y[:, 1, 1] - y[:, 0, 1])
    assert math.isclose(ci["mean"], per.mean(), abs_tol=1e-9) and math.isclose(ci["high"] - ci["mean"], 2.0226909 * per.std(ddof=1) / math.sqrt(n), rel_tol=1e-6)


def test_distributions():
    assert math.isclose(stats.t_two_sided(2.0, 10), 0.07338803477074037, rel_tol=1e-9)
    assert math.isclose(stats.t_ppf(0.975, 10), 2.2281388519649385, rel_tol=1e-9)
    assert math.isclose(stats.t_ppf(0.025, 1), -12.706204736174694, rel_tol=1e-8)
    assert math.isclose(stats.normal_two_sided(stats.Z975), 0.05, rel_tol=1e-9)
    assert stats.t_two_sided(0, 5) == pytest.approx(1) and math.isnan(stats.t_two_sided(1, 0))


def test_p_values_of_many_degrees_are_the_whole_series():
    import numpy as np

    def series(t, df):  # even and odd degrees, every term of it
        odd = df % 2
        j = np.arange(1, (df - 2 - odd) // 2 + 1)
        logs = np.concatenate([[0], np.cumsum(np.log((2 * j - 1 + odd) / (2 * j + odd)))])
        c, s = df / (df + t * t), t / math.sqrt(df + t * t)
        total = s * math.fsum(np.exp(logs + np.arange(len(logs)) * math.log(c)))
        return 1 - 2 / math.pi * (math.atan(t / math.sqrt(df)) + total * math.sqrt(c)) if odd else 1 - total

    for df in (25_640, 49_999, 51_282):  # the last two have more terms than the SQL's series
        for t in (0, 1e-9, 1e-6, 1e-5, 1e-3, 0.1, 0.5, 2, 4):
            assert stats.t_two_sided(t, df) == pytest.approx(series(t, df), abs=1e-9)


def test_scorers(spark):
    texts = spark.createDataFrame([(0, "a b a b a c".split()), (1, []), (2, ["a"])], "pos long, words array<string>")
    pairs = scoring.bigrams(texts)
    scorer = scoring.CountScorer(pairs, k=0.5)
    got = {(r["prev"], r["token"]): r["logp"] for r in scorer.score(spark.createDataFrame([("a", "b"), ("a", "z"), ("q", "b")], "prev string, token string")).collect()}
    assert got[("a", "b")] == pytest.approx(math.log(2.5 / (3 + 1.5))) and got[("a", "z")] == pytest.approx(math.log(0.5 / 4.5)) and got[("q", "b")] == pytest.approx(math.log(0.5 / 1.5))
    scored = spark.createDataFrame([(1, "x", 0, -1.0), (1, "x", 1, -2.0), (1, "y", 0, -3.0)], "item_id long, cand string, tok_pos int, logp double")
    assert scoring.sentence_logprob(scored, ["item_id"]).first()["logprob"] == -2.0
    assert scoring.mean_of_means(scored).first()["mean_mass"] == pytest.approx((math.exp(-1.5) + math.exp(-3)) / 2)
    first = factorial.first_and_mean(scored, ["cand"]).where("cand = 'x'").first()
    assert (first["surprisal_first"], first["surprisal_mean"]) == (1.0, 1.5)
    model = scoring.model_score(scored.drop("logp"), lambda f: -f.tok_pos)
    assert sorted(r["logp"] for r in model.collect()) == [-1.0, 0.0, 0.0]


def test_evaluators(spark):
    pairs = spark.createDataFrame([("u", 1.0, 1.0), ("u", 2.0, 1.0), ("u", None, 1.0)], "uid string, lp_good double, lp_bad double")
    r = evaluate.pair_accuracy(pairs, ["uid"]).first()
    assert (r["n_pairs"], r["n_correct"], r["accuracy"]) == (2, 1, 0.5)  # a tie is wrong
    assert one(spark, evaluate.arg_max_key(F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(2.0)))) == "b"
    steps = [r["step"] for r in evaluate.evaluation_steps(spark, 200, 500).collect()]
    assert steps == [200, 400, 500]
    anchors = spark.createDataFrame([(1, 0, 4), (1, 8, 12), (2, 0, 3)], "id long, a_start int, a_end int")
    toks = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 8, 12), (2, 0, 0, 3)], "id long, token_no int, start int, end int")
    assert evaluate.token_of_anchor(anchors.where("id = 2"), toks, "id").first()["token_no"] == 0
    one_row = spark.createDataFrame([(2, 0, 3)], "id long, a_start int, a_end int")
    assert evaluate.token_of_anchor(one_row, toks, "id").count() == 1


def test_streams_resume(spark, tmp_path):
    from corpusmill.streaming import packing

    docs = spark.range(12).select(F.lit("s").alias("source"), F.col("id").alias("pos"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 5)).alias("text"))
    schema = docs.schema
    docs.where("pos < 6").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = lambda: packing.packed(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), 16)
    out = lambda: packing.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert out().count() == 1
    docs.where("pos >= 6").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    assert sorted(r["block_no"] for r in out().collect()) == [0, 1, 2]  # 60 words: the rest of the first run is kept


def test_draws_go_on_in_order(spark, tmp_path):
    """Over two runs of a stream and two cycles each source gives its items in order."""
    from corpusmill.streaming import packing

    items = spark.createDataFrame([("a", i, 5) for i in range(5)] + [("b", i, 3) for i in range(3)], "source string, at long, n long").withColumn("text", F.concat("source", "at"))
    for part, (low, high) in enumerate(((0, 12), (12, 30))):
        spark.range(low, high).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "in" / "*"))
        stream = packing.drawn_items(packing.draws_in_order(ticks, {"a": 2, "b": 1}, 3, at="id"), items)
        got = packing.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    for source, n in (("a", 5), ("b", 3)):
        mine = got.where(F.col("source") == source).orderBy("pos").collect()
        assert [r["k"] for r in mine] == list(range(len(mine))) and [r["at"] for r in mine] == [k % n for k in range(len(mine))]
        assert len(mine) > 2 * n or source == "b"
    with pytest.raises(TimeoutError):
        packing.poll_until(spark, lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in" / "*")), str(tmp_path / "c2"), lambda b, i: None, lambda: False, rounds=2)


def test_lines_beyond_a_million(spark):
    """A document of more lines than 2^20: positions stay apart from the next document's."""
    n = (1 << 20) + 5
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.array_join(F.array_repeat(F.lit("x"), n), "\n")).otherwise("y").alias("text"))
    got = corpus.lines(docs)
    assert got.select("pos").distinct().count() == n + 1
    assert got.where("doc_id = 0").agg(F.max("pos").alias("m")).first()["m"] < got.where("doc_id = 1").first()["pos"]


def test_quantiles_by_rank(spark):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(2).integers(0, 30, 301)] + [1e9]
    rows = spark.createDataFrame([("g", v) for v in values] + [("h", 4.0), ("n", None)], "k string, v double")
    got = {r["k"]: r for r in order.quantiles(rows, "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}, "k").collect()}
    assert [got["g"][c] for c in "abcde"] == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.95, 1]))) and got["h"]["c"] == 4.0 and "n" not in got


def test_masses(spark):
    """Phrase masses and the evaluators over them, by hand on a small table of counts."""
    from corpusmill.operators import masses

    texts = spark.createDataFrame([(0, "the boy that the girl sees is here".split()), (1, "the girl sees the boy".split())], "pos long, words array<string>")
    scorer = scoring.CountScorer(scoring.bigrams(texts), k=1.0)
    n_vocab = 7  # boy that the girl sees is here
    p = lambda pair, prev: (pair + 1) / (prev + n_vocab)
    got = {(r["last"], r["phrase"]): r["mass"] for r in masses.phrase_masses(spark.createDataFrame([("sees", "the boy"), ("sees", "is")], "last string, phrase string"), scorer).collect()}
    assert got[("sees", "the boy")] == pytest.approx(math.sqrt(p(1, 2) * p(2, 4))) and got[("sees", "is")] == pytest.approx(p(1, 2))
    sentences = spark.createDataFrame([("The boy that the girl sees is here.",), ("The boy sees.",), ("No verb here.",)], "sentence string")
    row = masses.moved_embedded_vocabulary(sentences, ["sees"], ["boy", "girl"], ["boy", "girl", "cat"], scorer).first()
    g = lambda noun: math.sqrt(p(1, 2) * p(2, 4)) if noun != "cat" else math.sqrt(p(1, 2) * p(0, 4))
    assert row["roi_count"] == 2 and row["target_mass"] == pytest.approx(g("boy")) and row["embedded_mass"] == pytest.approx(g("girl"))
    assert row["vocab_mass"] == pytest.approx((g("cat") + (g("girl") + g("cat")) / 2) / 2)
    files = spark.createDataFrame([("c", "a.csv", 1.0), ("c", "a.csv", 3.0), ("c", "b.csv", 5.0)], "ckpt string, file string, np double")
    got = masses.masses_by_file(files, ["ckpt"], {"orc": "a.csv", "wh": "b.csv"}, ["np"]).first()
    assert (got["orc_np"], got["wh_np"]) == (2.0, 5.0)
    with pytest.raises(ValueError, match="no evaluator"):
        evaluate.run("nothing", files, ["ckpt"])


def test_tokenizers_and_catalogues(spark):
    from corpusmill.operators import experiments, tokenizers

    texts = spark.createDataFrame([(1, " it's  12\n"), (2, ""), (3, None)], "id long, text string")
    got = tokenizers.tokens(texts, "id").collect()
    assert [(r["token_no"], r["token"], r["start"], r["end"]) for r in got] == [(0, "it's", 1, 5), (1, "12", 7, 9)]
    parts = tokenizers.tokens(texts, "id", encode=tokenizers.by_pattern(r"\w+")).collect()
    assert [r["token"] for r in parts] == ["it", "s", "12"]
    assert [(r["task"], r["model"], r["evaluation"]) for r in experiments.tasks(spark, ["a", "b"], ["x", "y"]).orderBy("task").collect()] == [(0, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, "b", "y")]
    shares = experiments.mixtures(spark, {"r": (1.0, 0.0, 3.0)}, ("c4", "orc", "wh")).collect()
    assert [(r["source"], r["share"]) for r in shares] == [("c4", 0.25), ("wh", 0.75)]
    paths = spark.createDataFrame([("r", 200), ("r", 1000), ("s", 5)], "run string, step long")
    assert {(r["run"], r["step"]): r["keep"] for r in experiments.superseded(paths).collect()} == {("r", 200): False, ("r", 1000): True, ("s", 5): True}


def test_experiments(spark):
    from corpusmill.operators import experiments

    quads = generate.factorial_questions(spark, "iv")
    pairs = experiments.intervention_pairs(quads, labels=("noun", "verb"))
    assert pairs.count() == 2 * 1250
    assert experiments.intervention_pairs(quads.where("not (quadruplet_id = 3 and filler = 0 and gap = 1)")).where("quadruplet_id = 3").count() == 0
    corpora = spark.range(5).selectExpr("id as pos", "id * 2 as a")
    assert experiments.aligned(corpora, corpora.withColumnRenamed("a", "b")).count() == 5
    with pytest.raises(Exception, match="no partner at position 4"):
        experiments.aligned(corpora, corpora.where("pos < 4").withColumnRenamed("a", "b")).collect()
    rows = spark.createDataFrame([(1, "the cat sat", "cat"), (2, "no match", "cat"), (3, "c.t a c.t", "c.t")], "id long, text string, anchor string")
    got = {r["id"]: r["token_no"] for r in experiments.anchor_tokens(rows.where("id < 3"), "id", "text", "anchor").collect()}
    assert got == {1: 1, 2: None}
    assert experiments.anchor_tokens(rows, "id", "text", "anchor", strict=False).where("id = 3").first()["token_no"] == 0
    with pytest.raises(Exception, match="ambiguous"):
        experiments.anchor_tokens(rows, "id", "text", "anchor").collect()
    name = lambda s: one(spark, experiments.train_tag(F.lit(s)))
    assert [name(s) for s in ("train_a_augmented", "orc_baseline_wh_7", "x_baseline", "train_")] == ["a", "wh_7", "x", "train"]


def test_numbers_within_groups(spark):
    rows = spark.range(600).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("often").alias("s"), ((F.col("id") * 7919) % 600).alias("k"))
    got = order.running_sum(order.numbered(rows, "k", "n", ranges=5, total="all", by="s"), "k", "k", "before", ranges=7, by="s").orderBy("s", "k").collect()
    at, total, last = 0, 0, None
    for r in got:
        at, total = (0, 0) if r["s"] != last else (at, total)
        assert (r["n"], r["before"], r["all"]) == (at, total, 200 if r["s"] == "rare" else 400)
        at, total, last = at + 1, total + r["k"], r["s"]


def test_cloze_and_lexicons(spark):
    ex = spark.createDataFrame([(0, "a", {"x": 1.0, "y": 0.0}), (1, "a", {"x": 0.0, "y": 1.0}), (2, "b", {"x": 1.0, "y": 0.0}), (3, "b", {"x": 1.0, "y": 0.0})], "item long, category string, target_scores map<string,double>")
    scored = spark.createDataFrame([(0, "x", -1.0), (0, "y", -1.0), (1, "x", -1.0), (1, "y", -2.0), (2, "x", -1.0), (2, "y", -2.0), (3, "x", -1.0)], "item long, cand string, logp double")
    got = {r["category"]: (r["n"], r["n_correct"]) for r in evaluate.cloze_accuracy(ex, scored).collect()}
    assert got == {"a": (2, 1), "b": (1, 1), "ALL": (3, 2)}  # a tie goes to the first, an unscored example doesn't count
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    kinds = lambda rows: {(r["word"], r["kind"]) for r in corpus.lexicons(rows).collect()}
    assert kinds(words("Nation", "walked", "see")) == {("nation", "noun"), ("walked", "verb"), ("see", "verb")}
    assert kinds(words("dog", "see")) == {("dog", "noun"), ("see", "verb")}
    with pytest.raises(ValueError):
        corpus.lexicons(words("dog"))
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "z"]), (3, [])], "id long, ws array<string>")
    assert {r["id"] for r in corpus.all_known(rows, "id", "ws", words("a", "b")).collect()} == {1, 3}
    paths = spark.createDataFrame([("r", "p1", 1), ("r", "p10", 10)], "run string, path string, step long")
    assert evaluate.latest(paths, ["run"]).first()["path"] == "p10"
    assert len(one(spark, T.utc_now())) == 20


def test_large_samples_are_those_of_one_task(spark, monkeypatch):
    from corpusmill.operators import sampling

    rows = spark.range(300).withColumnRenamed("id", "k").repartition(5)
    for n in (0, 7, 250, 400):
        small = sorted(r["k"] for r in sampling.sample(rows, n, "k", 9).collect())
        monkeypatch.setattr(sampling, "TAKEN", -1)
        assert sorted(r["k"] for r in sampling.sample(rows, n, "k", 9).collect()) == small and len(small) == min(n, 300)
        monkeypatch.undo()


def test_counts_apart_by_a_column_and_rates_in_one_pass(spark):
    from corpusmill.operators import scoring

    rows = spark.createDataFrame([("x", "a", "b"), ("y", "a", "b"), ("x", "a", "b"), ("y", "a", "c")], "lang string, prev string, token string")
    scorer = scoring.CountScorer(rows, k=0.5, by="lang")
    got = {(r.prev, r.token): r for r in scorer.seen().withColumn("lp", scoring.pair_logp(0.5)).collect()}
    assert sorted(tuple(x) for x in got["a", "b"]._by) == [("x", 2), ("y", 1)] and sorted(tuple(x) for x in got["a", "c"]._by) == [("y", 1)]
    want = {(r.prev, r.token): r.logp for r in scoring.CountScorer(rows, k=0.5).score_seen(rows).collect()}
    assert {k: round(r.lp, 12) for k, r in got.items()} == {k: round(v, 12) for k, v in want.items()}
