"""Values of the words of texts by how often they and their pairs stand in the corpus, against joins of single words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import blocks, scoring
from corpusmill.plans import evaluation, evaluators, lexical

TEXTS = [(1, "a b a b a c"), (2, ""), (3, None), (4, "a"), (None, "b a"), (5, "é b a b é​x ß"), (6, " ".join(f"w{i % 7} a" for i in range(400))), (5, "a b")]


@pytest.mark.parametrize("block", [blocks.BLOCK, 1])
def test_text_logps(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "TOGETHER", 2)
    texts = spark.createDataFrame(TEXTS, "pos long, text string").select("pos", F.filter(F.split("text", " "), lambda w: w != "").alias("words")).repartition(3)
    got = sorted((str(r.pos), [round(x, 12) for x in r.logps]) for r in scoring.text_logps(texts, k=0.5).collect())
    pairs = [(p, ws[:-1], ws[1:]) for p, t in TEXTS for ws in [(t or "").split()] if len(ws) > 1]
    n_pair, n_prev = {}, {}
    for _, a, b in pairs:
        for x, y in zip(a, b):
            n_pair[x, y] = n_pair.get((x, y), 0) + 1
            n_prev[x] = n_prev.get(x, 0) + 1
    v = len({y for _, y in n_pair})
    want = sorted((str(p), [round(math.log((n_pair[x, y] + 0.5) / (n_prev[x] + 0.5 * v)), 12) for x, y in zip(a, b)]) for p, a, b in pairs)
    assert got == want


def test_chains(spark):
    row = spark.sql("SELECT array(ln(0.5D), ln(0.5D), ln(0.5D), ln(0.25D)) AS l").select(scoring.chain_probabilities("l", 3).alias("c"), scoring.total("l").alias("t")).first()
    assert [round(x, 12) for x in row.c] == [0.125, 0.25] and row.t == pytest.approx(math.log(1 / 32))


def test_no_row_for_each_word_is_shuffled(spark, sf):
    plan = evaluation.sentence_logprob(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(prev" not in plan and "SortMergeJoin" not in plan


def test_asked_pairs_have_the_scores_of_all(spark):
    texts = spark.createDataFrame([(0, "a b a b a c".split()), (1, []), (2, ["a"]), (3, None), (4, "c a d".split())], "pos long, words array<string>")
    every, some = scoring.CountScorer(scoring.bigrams(texts), k=0.5), scoring.AskedScorer(texts, F.col("token").isin("b", "d", "z"), k=0.5)
    rows = spark.createDataFrame([("a", "b"), ("a", "z"), ("q", "b"), (None, "b"), ("d", "b"), ("a", "d")], "prev string, token string")
    found = lambda df: sorted((r.prev, r.token, round(r.logp, 12)) for r in df.collect())
    assert found(some.score(rows)) == found(every.score(rows))
    assert found(some.score_seen(some.rows)) == found(every.score_seen(scoring.bigrams(texts).where("token in ('b', 'd')")))
    assert some.pairs.count() == 2  # not all four
    with pytest.raises(Exception, match="wasn't counted"):
        some.score(rows.withColumn("token", F.lit("c"))).collect()


def test_byte_chunks_write_texts_twice_only(spark, tmp_path, monkeypatch):
    from corpusmill.operators import order
    from corpusmill.sources import stores

    names, keep = [], order.stored
    for module in (order, stores):
        monkeypatch.setattr(module, "stored", lambda df, name: names.append(name) or keep(df, name))
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS int)) AS text").repartition(7)
    index = stores.byte_chunks(docs, str(tmp_path / "c"), "doc_id", 300, F.octet_length("text"))
    rows = spark.read.parquet(str(tmp_path / "c" / "rows"))
    assert [r.doc_id for r in rows.orderBy("row_no").collect()] == list(range(200))
    assert rows.select("chunk", F.input_file_name()).distinct().count() == index.count()
    assert "chunk-rows" not in names and names.count("order-rows") == 1  # that of the index


def test_sums_of_a_bucket_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(blocks, "TOGETHER", 3)
    most = []

    def unpacked(raw, keep=blocks._unpacked):
        most.append(raw)
        return keep(raw)

    monkeypatch.setattr(blocks, "_unpacked", unpacked)
    bucket, block = [0] * 10 + [1] * 4, [*range(10), *range(4)]
    items = [blocks._packed([f"a{b % 3}", "é", f"b{b}"]) for b in block]
    times = [blocks._pressed(np.array([2, 3, 4])) for _ in block]
    rows = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(block), pa.array(["f"] * 14), pa.array(items), pa.array(times)], ["bucket", "block", "file", "items", "times"])
    first = blocks._summed(iter([rows[:5], rows[5:10], rows[10:]]))
    got = next(first)
    assert got.num_rows == 3 and len(most) == 10  # rows leave some at a time, unpacked as they came
    got = [got, *first]
    assert [b.num_rows for b in got] == [3, 3, 3, 1, 3, 1]
    sums = [(k, n, blocks._loose(raw).tolist()) for b in got for k, n, raw in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "sums")))]
    assert sums == [(0, b, [2 * (4 if b % 3 == 0 else 3), 30, 4]) for b in range(10)] + [(1, b, [4 if b % 3 == 0 else 2, 12, 4]) for b in range(4)]


def test_no_row_for_each_word_of_chains_is_shuffled(spark, sf):
    plan = evaluators.chain_probabilities(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(prev" not in plan and "SortMergeJoin" not in plan


def test_lexical_queries_count_only_the_pairs_of_their_lists(spark, sf):
    w = lexical._Words(spark, sf)
    tokens = {r.token for r in w.scorer("x").pairs.select("token").distinct().collect()}
    assert tokens and tokens <= {"the", "x", *w.nouns, *w.verbs, *w.others}
