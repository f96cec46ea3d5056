"""Language identification, quality classification, vector search."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pytest
from compare import same
from pyspark.sql import functions as F

from corpusmill.llm import language_id, quality, vector_search


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(0, 7, 4)
        scores = rng.normal(size=(int(lengths.sum()), 3)) * 3
        label, at = language_id.viterbi(scores, lengths, 1.7), 0
        for n in lengths.tolist():
            value = lambda path: sum(scores[at + i, k] for i, k in enumerate(path)) - 1.7 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
            if n:
                assert value(label[at : at + n]) == pytest.approx(max(map(value, product(range(3), repeat=n))))
            at += n


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", "the quick brown fox jumps over the lazy dog and then the other"), ("ru", "быстрая лиса прыгает через ленивую собаку"), ("el", "η γρήγορη αλεπού πηδάει"), ("fr", "le renard brun saute par dessus le chien paresseux et puis les autres")]
    frame = spark.createDataFrame([(i, lang, t) for i in range(20) for lang, t in rows], "doc_id long, lang string, text string")
    return language_id.fit(frame)


def test_spans_and_scripts(spark, model):
    text = "the lazy dog and the fox jumps over the other быстрая лиса прыгает"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "12 !"), (4, "漢字")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in language_id.spans(rows, model).collect()}
    assert [(s["lang"], text[s["start"] : s["end"]].split()[0]) for s in got[1]] == [("en", "the"), ("ru", "быстрая")]
    assert got[2] == [] and got[3] == []
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predicted(rows, model).collect()}
    assert said[1][0] == "en" and 0 < said[1][1] < 1
    assert said[2] == ("und", 0.0) and said[3] == ("und", 0.0) and said[4][0] in model.langs


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    got = language_id.predicted(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == "und" for r in got) == 5
    none = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.predicted(odd_docs, none).collect()} == {"und"}
    assert language_id.predicted(no_docs, model).count() == 0
    kept = language_id.in_a_language(odd_docs, model)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count() - 5
    assert language_id.spans(odd_docs, none).count() == odd_docs.count()


def test_language_accuracy(spark):
    got = language_id.op2_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").merge(got, on="doc_id")
    held = docs[docs.held_out]
    assert len(docs) == 1000 and 150 < len(held) < 350
    assert (held.lang == held.lang_pred).mean() > 0.98


_M = (1 << 64) - 1


def brute_language(rows):
    """lang_pred and score of each row by plain dictionaries and one word at a time, learned from the rows that aren't held out."""
    import re
    import unicodedata
    import zlib
    from collections import Counter

    def words(text):
        out, word = [], ""
        for ch in (text or "").lower() + " ":
            letter = re.fullmatch(r"[^\W\d_]", ch)
            if letter or word and unicodedata.category(ch)[0] == "M":
                word += ch
            elif word:
                out.append(word)
                word = ""
        return out

    def script(ch):
        found = "other"
        for name, low, high in language_id.SCRIPTS:
            if low <= ord(ch) <= high:
                found = name
        return found

    def grams(word):
        points = [32, *map(ord, word), 32]
        return [((((a * 0x100000001B3 + b) & _M) * 0x100000001B3 + c) & _M) * 0x9E3779B97F4A7C15 % (1 << 64) >> 48 for a, b, c in zip(points, points[1:], points[2:])]

    langs = sorted({lang for i, lang, _ in rows if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2})
    counts, scripts = {lang: Counter() for lang in langs}, {lang: Counter() for lang in langs}
    for i, lang, text in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for w in words(text):
                counts[lang].update(grams(w))
                scripts[lang][script(w[0])] += 1
    total = {lang: sum(c.values()) + language_id.SMOOTH * language_id.BUCKETS for lang, c in counts.items()}
    memo = {}

    def scored(word):
        if word not in memo:
            score = {lang: float(np.float32(sum(np.log((counts[lang][g] + language_id.SMOOTH) / total[lang]) for g in grams(word)))) for lang in langs}
            may = {lang for lang in langs if scripts[lang][script(word[0])] > 0.01 * max(1, sum(scripts[lang].values()))} or set(langs)
            memo[word] = {lang: v if lang in may else min(score.values()) - 1000 for lang, v in score.items()}
        return memo[word]

    out = []
    for _, _, text in rows:
        held, path = words(text), []
        for w in held:
            score = scored(w)
            if not path:
                path.append({lang: (score[lang], None) for lang in langs})
                continue
            last = path[-1]
            top = max(langs, key=lambda k: last[k][0])
            path.append({lang: (score[lang] + max(last[lang][0], last[top][0] - language_id.SWITCH), lang if last[lang][0] >= last[top][0] - language_id.SWITCH else top) for lang in langs})
        letters = Counter()
        state = max(langs, key=lambda k: path[-1][k][0]) if path else None
        for w, step in zip(reversed(held), reversed(path)):
            letters[state] += sum(map(str.isalpha, w))
            state = step[state][1]
        n = sum(letters.values())
        best = min(letters, key=lambda k: (-letters[k], k)) if n else None
        out.append((best or "und", letters[best] / n if n else 0.0))
    return out


def test_language_query_by_brute_force(spark, sf):
    """Every document of the table: one word at a time, without blocks, memo or array operations."""
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    docs = docs[docs.text.isna() | (docs.text.str.len() < 20_000)]
    frame = spark.createDataFrame(docs[["doc_id", "lang", "text"]])
    got = language_id.predicted(frame, language_id.fit(frame.where(~language_id.held_out()))).toPandas().set_index("doc_id")
    want = brute_language(list(zip(docs.doc_id.tolist(), docs.lang.tolist(), docs.text.tolist())))
    for i, (lang, score) in zip(docs.doc_id, want):
        assert got.lang_pred[i] == lang and got.score[i] == pytest.approx(score, abs=1e-9)


def test_words_keep_their_marks():
    assert language_id._WORD.findall("हिन्दी में été a1b x\u0301y l'a") == ["हिन्दी", "में", "été", "a", "b", "x\u0301y", "l", "a"]


def brute_features(text):
    """Row of each feature with how often it stands in the text, one n-gram at a time."""
    from collections import Counter

    def bucket(h):
        return h * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - quality.BITS)

    def hashed(word):
        total = 0
        for place, ch in enumerate(word, 1):
            mixed = (ord(ch) * 0x9E3779B97F4A7C15 & _M) ^ (place * 0x94D049BB133111EB & _M)
            mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & _M
            total = total + (mixed ^ mixed >> 32) & _M
        return (total * 0xBF58476D1CE4E5B9 + len(word) + 1) & _M

    rows, words = Counter(), text.split()
    for w in words:
        marked = "\n" + w + "\n"
        for n in quality.GRAMS:
            for i in range(len(marked) - n + 1):
                h = ord(marked[i])
                for ch in marked[i + 1 : i + n]:
                    h = h * 0x100000001B3 + ord(ch) & _M
                rows[bucket(h + n & _M)] += 1
        rows[bucket(hashed(w) ^ 0x5555)] += 1
    for a, b in zip(words, words[1:]):
        rows[0 if a == b else bucket((hashed(a) * 0x100000001B3 & _M) ^ (hashed(b) * 0x9E3779B97F4A7C15 & _M))] += 1
    return rows


def test_quality_by_brute_force(spark):
    """Training and scores by a naive trainer: dictionaries of features, one vector row at a time."""
    rng = np.random.default_rng(4)
    pools = {1: ["house", "tree", "river", "été"], 0: ["$$$", "win!!", "free", "click"]}
    rows = [(i, int(i % 4 > 0), " ".join(rng.choice(pools[int(i % 4 > 0)] + ["the"], 8))) for i in range(24)] + [(24, 1, ""), (25, 0, None)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, rows=6)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}

    n = {y: sum(r[1] == y for r in rows) for y in (0, 1)}
    order = [r[0] for r in docs.select("doc_id", quality.by_hash("doc_id", "quality-fit").alias("h")).orderBy("h", "doc_id").collect()]
    chosen = {y: [i for i in order if rows[i][1] == y][:6] for y in (0, 1)}
    sample = sorted(chosen[0] + chosen[1])
    feats = []
    for i in sample:
        f = brute_features(rows[i][2] or "")
        total = sum(f.values())
        feats.append([(k, float(np.float16(v / total))) for k, v in sorted(f.items())])
    draw = np.random.default_rng(quality.SEED)
    vectors = draw.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32).astype(float)
    weights, offset = np.zeros((2, quality.DIM)), np.zeros(2)
    epochs = max(quality.EPOCHS, -(-quality.STEPS // len(sample)))
    step, steps = 0, epochs * len(sample)
    for _ in range(epochs):
        for d in draw.permutation(len(sample)):
            rate = quality.RATE * (1 - step / steps)
            step += 1
            mean = np.zeros(quality.DIM)
            for k, share in feats[d]:
                mean += share * vectors[k]
            z = weights @ mean + offset
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            error = p - np.eye(2)[rows[sample[d]][1]]
            down = error @ weights
            weights -= rate * np.outer(error, mean)
            offset -= 0.1 * rate * error
            for k, share in feats[d]:
                vectors[k] -= rate * share * down * quality.SPEED
    shift = np.log((n[1] / len(chosen[1])) / (n[0] / len(chosen[0])))
    for i, _, text in rows:
        f = brute_features(text or "")
        z = offset[1] - offset[0] + shift
        if f:
            z += sum(v * (vectors[k] @ (weights[1] - weights[0])) for k, v in f.items()) / sum(f.values())
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-3)


def test_labels_with_other_columns(spark, odd_docs):
    """Columns of labels and documents whose names clash with those that are read or made change nothing."""
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (7, 1, 0), (9, 0, 0), (None, 1, 1), (3, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    plain = quality.scored(odd_docs.select("doc_id", "text"), quality.fit(odd_docs.select("doc_id", "text"), labels))
    wide = labels.selectExpr("*", "'x' as text", "1 as _id", "0 as _label", "2 as _hash", "'r' as rows")
    docs = odd_docs.selectExpr("*", "3 as _id", "4 as _label", "5 as quality", "6 as shares")
    got = quality.scored(docs, quality.fit(docs, wide))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_scores_are_calibrated(spark):
    """The mean score of held-out labelled documents is near their share of label 1, though the classes are sampled alike."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.where("quality is not null"), "doc_id")
    model = quality.fit(docs, labels.where(~quality.held_out()), rows=300)
    got = quality.scored(known.where(quality.held_out()).select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    assert abs(got.score.mean() - got.quality.mean()) < 0.05 and (got.predicted == got.quality).mean() > 0.98


def test_word_features():
    words = ["the", "then", "t", "été", "a|b", "🙂x"]
    rows, whose, hashes = quality.word_features(words)
    assert len(set(hashes.tolist())) == len(words)
    for i, w in enumerate(words):
        alone = quality.word_features([w])
        assert sorted(rows[whose == i].tolist()) == sorted(alone[0].tolist()) and hashes[i] == alone[2][0]
        marked = "\n" + w + "\n"
        assert (whose == i).sum() == 1 + sum(max(0, len(marked) - n + 1) for n in quality.GRAMS)


def test_scorer_is_the_mean_of_the_features():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    texts = ["a b b c", "", "x", "word word other", "é " * 50]
    for t, p in zip(texts, quality.Scorer(model).scores(texts)):
        rows, times = quality.document_features(t)
        z = 0.3 + (float((model.logits[rows] * times).sum() / times.sum()) if len(rows) else 0)
        assert p == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def test_training_separates():
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["house", "tree", "river", "stone"], 30)) for _ in range(60)]
    bad = [" ".join(w + "$$$" for w in rng.choice(["house", "tree", "river", "stone"], 30)) for _ in range(60)]
    vectors, weights, offset = quality.train([quality._shares(t) for t in good + bad], np.array([1] * 60 + [0] * 60))
    model = quality.Model(vectors @ (weights[1] - weights[0]), float(offset[1] - offset[0]))
    score = quality.Scorer(model).scores(["river house tree", "river$$$ lake$$$ moon$$$"])
    assert score[0] > 0.5 > score[1]


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 1), (10, 0), (99, 1), (4, None), (5, 7), (1, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    got = quality.scored(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    one = quality.fit(odd_docs, labels.where("quality = 1"))
    assert len({r["score"] for r in quality.scored(odd_docs, one).collect()}) == 1
    none = quality.fit(no_docs, labels.where("false"))
    assert {r["score"] for r in quality.scored(odd_docs, none).collect()} == {0.5}
    assert quality.scored(no_docs, model).count() == 0
    assert quality.of_quality(odd_docs, none).schema == odd_docs.schema


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op10_quality(spark, sf).toPandas()
    rows = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = rows[rows.held_out]
    good, bad = (held.score[held.quality == q].to_numpy() for q in (1, 0))
    assert len(got) == 10_000 and (good[:, None] > bad).mean() > 0.99 and (held.predicted == held.quality).mean() > 0.98


# vectors


def brute_top(rows, every, k):
    q = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for a, (i, v) in enumerate(q):
        if i % every == 0:
            others = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(q) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(others, 1)]
    return sorted(out)


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(120)]
    rows += [(i, [0.5, 0.0, 0.0, -0.5, 0.0, 0.0]) for i in range(120, 140)]  # ties and zeros
    rows += [(200, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (206, [float("inf")] * 6), (None, [1.0] * 6), (0, [9.0] * 6), rows[5]]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, part int, q string")
    got = vector_search.top_k(frame, F.col("vec_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)
    assert vector_search.top_k(frame.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    few = frame.where("vec_id in (10, 11, 12)")
    assert vector_search.top_k(few, F.col("vec_id") % 10 == 0).count() == 2


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 16 * 72)
    monkeypatch.setattr(vector_search, "QUERIES", 3 * 72)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5) / 4]) for i in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_search.top_k(frame, F.col("vec_id") % 7 == 0, k=4).collect())) == brute_top(rows, 7, 4)


def test_top_k_of_huge_components(spark):
    """Every finite vector takes part; scores are exact, and clipped to a long where it can't hold them."""
    rows = [(10, [1.0, 2.0]), (20, [1e7, 1.0]), (3, [1e7, 1.0]), (4, [1e300, -1.0]), (5, [-1e300, 0.5]), (6, [1e300, 1.0]), (7, [0.5, 0.25]), (10, [3.0, -1.0]), (8, [1.7e308, 1.7e308])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_k(frame, F.col("vec_id") % 10 == 0, k=8).collect()
    q = [(i, vector_search.integers(np.array(v))) for i, v in rows]
    want = []
    for a, (i, x) in enumerate(q):
        if i % 10 == 0:
            scores = sorted((-sum(s * t for s, t in zip(x, y)), j) for b, (j, y) in enumerate(q) if b != a)
            want += [(i, r + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, j) in enumerate(scores[:8])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert vector_search.integers(np.array([1.7e308, -0.001])) == [int(1.7e308) * 256, -1]


def test_top_k_query(spark, sf, duck):
    same(vector_search.op7_top_k(spark, sf).toPandas(), duck.sql(vector_search.SQL).df())


def test_labels_without_a_document_use_up_no_bound(spark):
    """With a bound of three a class, the few documents that are there are learnt from among many labels."""
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad junk") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    model = quality.fit(docs, labels, rows=3)
    score = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert min(score[i] for i in (1, 3, 5)) > max(score[i] for i in (0, 2, 4))
