"""Vector codes, alignment of tokenizers and mixing to target weights against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import alignment, target_mix, vector_codes
from corpusmill.llm.common import stored

PATHS = tuple(map(public_tokenizers.path, (alignment.VOCABULARY, alignment.RANKS, alignment.MODEL)))


# Vector codes


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(0, 13), st.sampled_from([3, 400, 10**30]), st.integers(0, 10**6))
def test_nearest_is_exact_and_lowest_of_ties(n, entries, width, most, seed):
    rng = random.Random(seed)
    kind = object if most > 10**9 else np.int64
    draw = lambda k: np.array([[rng.randint(-most, most) for _ in range(width)] for _ in range(k)], kind).reshape(k, width)
    x, c = draw(n), draw(entries)
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in c] for p in x]
    at, distance = vector_codes.nearest(x, c)
    assert at.tolist() == [d.index(min(d)) for d in far]
    assert distance.tolist() == [min(d) for d in far]


def brute_codes(rows, parts, entries, rounds, scale):
    """rows of (vec_id, vector, label) that take part, in the order of the first codebooks."""
    width = max((len(v) for _, v, _ in rows), default=0)
    width += -width % parts
    whole = [[int(np.floor(Fraction(float(x)) * scale)) for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    w = width // parts
    cut = [[q[p * w : (p + 1) * w] for q in whole] for p in range(parts)]
    books = [[list(q) for q in cut[p][:entries]] for p in range(parts)]

    def near(p):
        far = [[sum((a - b) ** 2 for a, b in zip(q, e, strict=True)) for e in books[p]] for q in cut[p]]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for q, (e, _) in zip(cut[p], near(p), strict=True):
                of[e].append(q)
            books[p] = [[sum(col) // len(of[e]) for col in zip(*of[e], strict=True)] if e in of else b for e, b in enumerate(books[p])]
    found = [near(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [min(sum(found[p][i][1] for p in range(parts)), 2**63 - 1) for i in range(len(rows))]
    total = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] += e
    return [(i, "".join(f"{found[p][k][0]:02x}" for p in range(parts)), errors[k], min(total[label], 2**63 - 1), digest) for k, (i, _, label) in enumerate(rows)]


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
SCHEMA = "vec_id long, embedding array<float>, label int, size int, q string, large string, code string, _label string, _rows int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "q", "l", "c", "x", 9) for r in rows], SCHEMA)


def test_codes_of_odd_vectors(spark):
    """Nulls, other lengths, ties, repeated rows, clashing columns; more vectors than entries."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.001, 0.25, 1.0]) for _ in range(rng.choice([6, 8, 8]))], rng.choice([1, 2, None])) for i in range(200)]
    rows += [(500, [0.5] * 8, 1), (500, [0.5] * 8, 1), (None, [0.125] * 8, None)]
    odd = [(600, None, 1), (601, [1.0, None], 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, None)]
    got = vector_codes.compressed(vectors(spark, rng.sample(rows, len(rows)) + odd).repartition(7), entries=16)
    want = brute_codes(rows, 4, 16, 4, 1024)
    assert sorted(map(repr, map(tuple, got.select(COLUMNS).collect()))) == sorted(map(repr, want))


def test_codes_of_few_and_of_large_vectors(spark):
    """Fewer vectors than entries, and components that 64 bits don't hold."""
    rows = [(1, [1e20, 2.0, -1e30, 0.5], 1), (2, [0.25, 2.0, -1e30, 0.5], 1), (3, [1e20, 1e4, 5.0, 0.5], None)]
    got = vector_codes.compressed(vectors(spark, rows))
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == sorted(brute_codes([(i, np.array(v, np.float32).tolist(), x) for i, v, x in rows], 4, 256, 4, 1024))
    few = vector_codes.compressed(vectors(spark, [*rows, *[(k, [1e20 * k, 1.5, k / 3, -7.0], 2) for k in range(4, 30)]]), entries=4, rounds=2)
    every = rows + [(k, [1e20 * k, 1.5, k / 3, -7.0], 2) for k in range(4, 30)]
    assert sorted(tuple(r)[:2] for r in few.select(COLUMNS).collect()) == sorted(r[:2] for r in brute_codes([(i, np.array(v, np.float32).tolist(), x) for i, v, x in every], 4, 4, 2, 1024))


def test_codes_of_the_table(spark, sf, duck):
    got = vector_codes.op11_vector_codes(spark, sf).select(COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(vector_codes.SQL).project(", ".join(COLUMNS)).fetchall())


def test_codes_of_nothing(spark):
    assert vector_codes.compressed(vectors(spark, [(1, None, 1)])).count() == 0
    empty = vector_codes.compressed(vectors(spark, [(1, [], 1), (2, [], None)]))
    assert sorted((r.vec_id, r.code, r.error) for r in empty.collect()) == [(1, "00000000", 0), (2, "00000000", 0)]


# Alignment


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    return a, b, char


def brute_alignment(texts, libraries):
    a_lib, b_lib, char = libraries
    rows, count = [], Counter()
    for text in texts:
        rows.append(None)
        if not text:
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        a_raw = [bytes(char[c] for c in a_lib.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            continue
        a_end, b_end = ({int(e): i for i, e in enumerate(np.cumsum([len(x) for x in raw]))} for raw in (a_raw, b_raw))
        cut = sorted(a_end.keys() & b_end.keys())
        links, groups, i, j = [(a[a_end[c]], b[b_end[c]]) for c in cut], [], 0, 0
        for c in cut:
            groups.append(",".join(map(str, a[i : a_end[c] + 1])) + "|" + ",".join(map(str, b[j : b_end[c] + 1])))
            i, j = a_end[c] + 1, b_end[c] + 1
        count.update(links)
        rows[-1] = (len(a), len(b), groups, links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()))
    return out, count


def test_alignment_of_odd_texts(spark, odd_docs, libraries):
    extra = ["tab\there\n\n two  spaces ", "▁ marks ▁▁", "emoji 🙂🙂 ñandú", "  x\u0085y", "a" * 30000, "ﬁ ligature ½ ①", "<s></s><unk> <0x41>", " ", "\n", "x\x00y", "ａｂｃ　全角"]
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = stored(alignment.tokenised(docs.repartition(3), PATHS), "test-tokens")
    got = alignment.alignment_digests(tokens, PATHS).collect()
    numbers, count = brute_alignment([t for _, t in rows], libraries)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, *n)) for (d, _), n in zip(rows, numbers, strict=True))
    assert sum(n[0] > 0 for n in numbers) > 12 and sum(n[0] == 0 for n in numbers) > 4
    pairs = {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.n for r in alignment.link_counts(tokens, PATHS).collect()}
    assert pairs == count
    assert len(pairs) <= alignment.Tokens(*PATHS[1:]).pair_bound()


def test_alignment_of_the_table(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, alignment.op12_token_alignment(spark, sf).collect()))
    assert got == sorted((r.doc_id, *n) for r, n in zip(docs, brute_alignment([r.text for r in docs], libraries)[0], strict=True))


def test_aligned_gives_cuts_and_overlaps(spark):
    tokens = alignment.tokenised(spark.createDataFrame([(1, "unbelievable things, ¿no?"), (2, None), (3, "on")], "doc_id long, text string").coalesce(1), PATHS)
    both = alignment.Tokens(*PATHS[1:])
    for r in alignment.unpacked(tokens, PATHS, with_alignment=True).collect():
        a, b = (np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((both.a_bytes, r.a_ids), (both.b_bytes, r.b_ids)))
        assert [a[i] for i in r.a_ends] == [b[i] for i in r.b_ends] == sorted(set(a) & set(b))
        spans = lambda ends: list(zip([0, *ends], ends))
        shared = [(i, j) for i, x in enumerate(spans(a)) for j, y in enumerate(spans(b)) if max(x[0], y[0]) < min(x[1], y[1])]
        assert list(zip(r.a_over, r.b_over, strict=True)) == sorted(shared)
    plain = sorted(alignment.unpacked(tokens, PATHS).collect())
    assert [(r.doc_id, len(r.a_ids) > 0, len(r.b_ids) > 0) for r in plain] == [(1, True, True), (2, False, False), (3, True, True)]


def test_alignment_of_nothing(spark, no_docs):
    assert alignment.alignment_digests(stored(alignment.tokenised(no_docs, PATHS), "none"), PATHS).count() == 0


# Mixing


def brute_targets(sizes, weights, share, epochs):
    """Targets of sources in order, as fractions."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, capped = [Fraction(0)] * len(sizes), set()
    left = Fraction(share) * sum(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        if not open_:
            return target
        rate = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if weight[i] * rate > epochs * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weight[i] * rate
            return target
        for i in over:
            target[i] = Fraction(epochs * sizes[i])
            left -= target[i]
            capped.add(i)


@pytest.mark.parametrize("seed", range(3))
def test_mix_of_odd_sources(spark, seed):
    """Null and empty names and ids, repeated rows, a hot source, sources without words, names beyond the basic plane."""
    rng = random.Random(seed)
    names = ["", "a", "b", "Z", None, "é", "￿", "\U0001f600", "none", "c", "d"]
    rows = [(rng.randint(0, 500), rng.choice(names + ["a"] * 6), " ".join("w" * rng.randint(0, 30))) for _ in range(700)]
    rows += [(i, "none", None) for i in range(4)] + [(None, "a", "x y z")] * 40 + [(7, "b", "one two")] * 30 + [(None, None, None), (8, "b", " \t\n"), (9, "b", "x y z\x85q")]
    docs = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], "doc_id long, source string, text string, size int, _copies int, _key string, start int").repartition(5)
    got = target_mix.mixed(docs).collect()
    size_of = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(d), str(s), size_of(t)) for d, s, t in rows)
    total, held = Counter(), defaultdict(list)
    for _, s, t in rows:
        total[s] += size_of(t)
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    want = dict(zip(order, brute_targets([total[s] for s in order], (5, 2, 1), 1.5, 2), strict=True))
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        held[r.source].append(r)
    for s, mine in held.items():
        assert sum(r.taken for r in mine) == int(want[s] + Fraction(1, 2))
        mine.sort(key=lambda r: (r.start, r.size, r.taken))
        places = sorted((r.start, r.start + r.size) for r in mine if r.size)
        assert all(x[1] == y[0] for x, y in zip(places, places[1:])) and (not places or (places[0][0], places[-1][1]) == (0, total[s]))
    again = target_mix.mixed(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_with_parameters(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", i + 1) for i in range(90)], "doc_id long, source string, n long")
    got = target_mix.mixed(docs.withColumn("text", F.lit("x")), weights=(1, 3), share=2.5, epochs=3, size=F.col("n"))
    sizes = [sum(i + 1 for i in range(90) if i % 3 == s) for s in range(3)]
    want = brute_targets(sizes, (1, 3), 2.5, 3)
    taken = {r.source: r.t for r in got.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert [taken[f"s{s}"] for s in range(3)] == [int(t + Fraction(1, 2)) for t in want]


def test_mix_deals_out_many_copies(spark, monkeypatch):
    monkeypatch.setattr(target_mix, "COPIES", 7)
    docs = spark.createDataFrame([(1, "a", "x y")] * 23 + [(2, "a", "z")], "doc_id long, source string, text string")
    got = sorted((r.start, r.size) for r in target_mix.mixed(docs).collect())
    assert len(got) == 24 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


def test_mix_of_nothing(spark, no_docs):
    assert target_mix.mixed(no_docs.withColumn("source", F.lit("s"))).count() == 0
    silent = target_mix.mixed(spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in silent] == [(0, 0, 0.0, 0)] * 2


def test_mix_of_the_table(spark, sf, duck):
    got = target_mix.op13_target_mix(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(target_mix.SQL).project(", ".join(got.columns)).fetchall())


def test_mix_has_no_python_in_its_plan(spark, sf):
    plan = target_mix.op13_target_mix(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExternalRDD", "LogicalRDD"))
