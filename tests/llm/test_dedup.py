"""Exact and near deduplication against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from compare import same

from corpusmill.llm import components, exact_dedup, fuse, golay, simhash


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_filters_hold_their_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    blob = fuse.build(np.append(keys, keys))
    assert fuse.contains(blob, keys).all()
    assert fuse.contains(blob, rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.002


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_dedup(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = exact_dedup.exact_dedup(odd_docs)
    assert got.columns == COLUMNS
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_exact(rows), key=key)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_passes_columns(odd_docs, no_docs):
    got = exact_dedup.without_copies(odd_docs)
    assert got.schema == odd_docs.schema and exact_dedup.without_copies(no_docs).count() == 0
    ids = sorted(r["doc_id"] for r in got.where("doc_id is not null").collect())
    assert ids == [-5, 3, 3, 4, 6, 7, 8, 9, 10, 11, 11, 12, 13]


def test_exact_dedup_query(spark, sf, duck):
    same(exact_dedup.op1_exact_dedup(spark, sf).toPandas(), duck.sql(exact_dedup.SQL).df())


def test_filters_screen_and_buckets_decide(spark):
    """What a filter lets through wrongly finds no row in the exact bucket."""
    rows = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    groups = exact_dedup.groups_of(exact_dedup.digests(rows))
    filters = exact_dedup.snapshots(groups)
    passed = exact_dedup.screened(groups, filters).count()
    exact = groups.alias("a").join(groups.alias("b"), "digest").where("a.batch > b.batch").count()
    assert passed >= exact > 0


# SimHash


def test_golay_code():
    """By linearity the cosets' leaders with every error of one or two bits are all cases."""
    reps = np.unique([(1 << a) | (1 << b) | (1 << c) for a in range(23) for b in range(23) for c in range(23)] + [0])
    assert len({int(golay._tables()[0][r & 0xFFF] ^ golay._tables()[1][r >> 12]) for r in reps}) == 2048
    near = golay.keys(reps)
    assert (near[:, 0] >= 0).all()

    def meet(a, b, first):
        ok = np.zeros(len(a), bool)
        for i in range(golay.KEYS):
            for j in range(golay.KEYS):
                if not first or 0 in (i, j):
                    ok |= (a[:, i] >= 0) & (a[:, i] == b[:, j])
        return ok.all()

    for a in range(23):
        assert meet(near, golay.keys(reps ^ (1 << a)), True)
        for b in range(a):
            assert meet(near, golay.keys(reps ^ (1 << a) ^ (1 << b)), False)


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=4):
    """Label of each distinct fingerprint: the smallest one reachable."""
    u = np.unique(np.array(prints, np.uint64))
    label = np.arange(len(u))
    while True:
        new = np.array([label[np.bitwise_count(u ^ x) <= bits].min() for x in u])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return dict(zip(u.tolist(), label.tolist()))
        label = new


def test_fingerprints(odd_docs):
    for text in ["", " \t", "a", "a B c", "a b c d", "A b c d e\x0bf", "é É x y z", "x " * 500, None]:
        assert simhash.fingerprint(text or "") == brute_print(text)
    rows = simhash.fingerprints(odd_docs).collect()
    assert len(rows) == odd_docs.count()


def test_near_groups(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    label = brute_components([brute_print(t) for _, t in rows])
    least = {}
    for i, t in rows:
        k = label[brute_print(t)]
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = [(i, f"{brute_print(t):016x}", least.get(label[brute_print(t)])) for i, t in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    got = simhash.near_groups(odd_docs)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert simhash.near_groups(no_docs).count() == 0


def test_near_copies_pass_columns(odd_docs, no_docs):
    got = simhash.without_near_copies(odd_docs)
    assert got.schema == odd_docs.schema and simhash.without_near_copies(no_docs).count() == 0


def test_keys_meet():
    """Fingerprints within four bits share a key, whichever segments the bits fall into."""
    rng = np.random.default_rng(8)
    u = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    v = u.copy()
    for i in range(len(v)):
        for b in rng.choice(64, 1 + i % 4, replace=False):
            v[i] ^= np.uint64(1 << int(b))
    (ku, iu), (kv, iv) = (simhash.fuzzy_keys(x.view(np.int64)) for x in (u, v))
    mine = [set() for _ in u]
    for k, i in zip(ku.tolist(), iu.tolist()):
        mine[i].add(k)
    met = set(i for k, i in zip(kv.tolist(), iv.tolist()) if k in mine[i])
    assert len(met) == len(u) and len(ku) < 115 * len(u)


def test_other_distances_are_errors(spark):
    frame = spark.createDataFrame([(1,)], "fp long")
    for bits in (0, 5):
        with pytest.raises(ValueError, match="bits"):
            simhash.linked_fingerprints(frame, bits)


def test_near_copies_of_a_repeated_id(spark):
    """A row goes by its id and text together."""
    a, b = "one two three four five six seven", "quite another text with other words in it"
    rows = spark.createDataFrame([(5, a), (11, a), (11, b)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.without_near_copies(rows).collect())) == [(5, a), (11, b)]


def test_hot_keys_keep_their_rows(spark):
    """A join in which hot keys are broadcast gives the rows of a plain join."""
    from corpusmill.llm.common import joined_hot

    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 700) as k", "id as v")
    groups = rows.groupBy("k").count().selectExpr("k", "count as size", "k * 2 as twice").where("k % 5 <> 1")
    got = joined_hot(rows, groups, ["k"], "size", 5000)
    want = rows.join(groups.drop("size"), "k").select("k", "v", "twice")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert joined_hot(rows, groups, ["k"], "size", 5000, left=True).count() == 5000


def test_screens_say_no_only_to_strangers(spark):
    from pyspark.sql import functions as F

    from corpusmill.llm.common import screen

    inside = spark.range(1000).select(F.xxhash64("id").alias("h"))
    test = screen(inside)
    got = spark.range(20_000).where(test(F.xxhash64("id")))
    assert got.where("id < 1000").count() == 1000 and got.count() < 1100
    assert spark.range(10).where(screen(inside.where("false"))(F.xxhash64("id"))).count() == 0


@pytest.mark.parametrize(("cap", "bits"), [(cap, bits) for cap in (simhash.CAP, 40, 3, 1) for bits in (1, 2, 3, 4)])
def test_no_link_is_lost(spark, cap, bits):
    """Chains, balls and pairs at up to five bits give the components of all pairs, also where keys run over."""
    rng = np.random.default_rng(cap)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    parts = [base]
    for _ in range(4):
        moved = parts[-1].copy()
        for i in range(len(moved)):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                moved[i] ^= np.uint64(1 << int(b))
        parts.append(moved)
    ball = np.full(200, base[0])
    for i in range(len(ball)):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            ball[i] ^= np.uint64(1 << int(b))
    prints = np.unique(np.concatenate([*parts, ball]))
    want = brute_components(prints, bits)
    frame = spark.createDataFrame(pd.DataFrame({"fp": prints.view(np.int64)}))
    roots = components.components(simhash.linked_fingerprints(frame, bits, cap)).toPandas()
    root = dict(zip(roots.node, roots.root))
    found = {}
    for p in prints.view(np.int64).tolist():
        found.setdefault(root.get(p, p), set()).add(p)
    wanted = {}
    for p, k in want.items():
        wanted.setdefault(k, set()).add(int(np.uint64(p).view(np.int64)))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id as u", "id + 1 as v")
    got = components.components(edges).collect()
    assert len(got) == 300 and {r["root"] for r in got} == {0}
    assert components.components(edges.where("false")).count() == 0


def test_near_query_at_scale(spark, sf):
    """The whole table against all pairs."""
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    prints = [brute_print(t) for t in docs.text]
    label = brute_components(prints)
    least = {}
    for i, p in zip(docs.doc_id, prints):
        least[label[p]] = min(i, least.get(label[p], i))
    got = simhash.op5_simhash(spark, sf).toPandas().set_index("doc_id")
    for i, p in zip(docs.doc_id, prints):
        assert got.fingerprint[i] == f"{p:016x}" and got.component_id[i] == least[label[p]]
