"""The near stage's rule, 5-word similarity of 0.8 or more, against all pairs."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from corpusmill.llm import similar


def brute_kept(rows):
    """The smallest doc_id of each component over pairs of similarity 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    least = {}
    for (d, _), k in zip(rows, label):
        least[k] = min(d, least.get(k, d))
    return sorted(d for (d, _), k in zip(rows, label) if d == least[k])


def test_near_stage_catches_looser_copies(spark, sf):
    """Copies with one to four changed words, most of them over four fingerprint bits apart."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 5):
            copy = list(words)
            for at in rng.choice(100, j, replace=False):
                copy[at] = "changed"
            rows.append((10 * i + j, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, frame, sf).collect())
    assert got == brute_kept(rows) and not any(d % 10 == 1 for d in got)


def test_second_round_links_what_the_first_leaves(spark):
    """Of a key's sets, those that the first round left in different components are compared by their sketches and shingles."""
    rng = np.random.default_rng(1)
    a, b, c = (np.unique(rng.integers(0, 1 << 63, 200, np.uint64)) for _ in range(3))
    near_b = np.unique(np.append(b[:190], c[:10]))  # similarity 0.9
    sets = {1: a, 2: b, 3: near_b, 4: c, 5: b[1:]}
    rows = spark.createDataFrame([(7, n, 200, (1, 200)) for n in sets], "key long, node long, n int, lead struct<node:long,n:int>")
    assert sorted(map(tuple, similar.first_pairs(rows).collect())) == [(1, 2), (1, 3), (1, 4), (1, 5)]
    roots = spark.createDataFrame([(5, 2)], "node long, root long")
    drawn = spark.createDataFrame([(n, similar.sketch(x).astype("<u4").tobytes(), x.view(np.int64).tolist()) for n, x in sets.items()], "node long, sketch binary, shingles array<long>")
    for chunk in (similar.CHUNK, 2, 1):
        similar.CHUNK, old = chunk, similar.CHUNK
        got = {tuple(sorted(p)) for p in map(tuple, similar.other_links(rows, roots, lambda asked: drawn.join(asked, "node", "left_semi"), 5).collect())}
        similar.CHUNK = old
        assert got and got <= {(2, 3), (3, 5)}


def test_many_copies_of_one_text(spark, sf):
    """A large group whose members are similar to some others only: all components are found, and pairs don't pile up."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(60, rng.integers(1, 4), replace=False):
            words[at] = f"x{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.without_similar(frame).collect()) == brute_kept(rows)


def test_sketches_estimate_similarity():
    """Shares of equal sketch values are near the sets' similarity."""
    rng = np.random.default_rng(3)
    for n in (20, 200, 3000):
        every = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for share in (0.5, 0.8, 0.95):
            k = int(len(every) * share)
            got = [(similar.sketch(every) == similar.sketch(rng.permutation(every)[:k])).mean() for _ in range(20)]
            assert abs(np.mean(got) - k / len(every)) < 0.03


def test_near_stage_on_documents(spark):
    """All rows of sf0.01 that 5-word similarity links, against all pairs of shingle sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = [similar.shingles(t or "") for _, t in rows]
    words = np.unique(np.concatenate(sets))
    held = [np.searchsorted(words, s) for s in sets]
    label = np.arange(len(rows))
    n_pairs = 0
    by_word = {}
    for i, h in enumerate(held):
        seen = {}
        for w in h.tolist():
            for j in by_word.setdefault(w, []):
                seen[j] = seen.get(j, 0) + 1
            by_word[w].append(i)
        for j, both in seen.items():
            if 5 * both >= 4 * (len(held[i]) + len(held[j]) - both):
                n_pairs += 1
                label[label == max(label[i], label[j])] = min(label[i], label[j])
        if not len(h):
            label[i] = min([k for k in range(i + 1) if not len(held[k])])
    least = {}
    for (d, _), k in zip(rows, label.tolist()):
        least[k] = min(d, least.get(k, d))
    kept = sorted(r["doc_id"] for r in similar.without_similar(docs).collect())
    assert n_pairs > 20 and kept == sorted(set(least.values()))


def test_rows_of_one_id(spark, odd_docs, no_docs):
    got = similar.without_similar(odd_docs)
    assert got.schema == odd_docs.schema and similar.without_similar(no_docs).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "other text")], "doc_id long, text string")
    assert sorted(map(tuple, similar.without_similar(rows).collect())) == [(1, "a b c d e f g"), (2, "other text")]
