"""Subword tokens against a matcher that tries every entry at every place."""

from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.operators import corpus, evaluate, subwords


def brute(text, entries, mark, leading_space):
    got, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = at
        while end < len(text) and not text[end].isspace():
            end += 1
        word, places = mark + text[at:end], [*([at] * len(mark)), *range(at, end + 1)]
        i = 0
        while i < len(word):
            k = max((len(e) for e in entries if word.startswith(e, i)), default=None)
            j = i + (k or 1)
            start = places[i] - (1 if i < len(mark) and leading_space and at else 0)
            got.append((word[i:j], None if k is None else entries[word[i:j]], start, places[j]))
            i = j
        at = end
    return got


@settings(max_examples=300, deadline=None)
@given(st.text("abé▁ \n😀", max_size=25), st.sets(st.text("abé▁😀", min_size=1, max_size=4), max_size=12), st.sampled_from(["", "▁"]), st.booleans())
def test_longest_match(text, entries, mark, leading_space):
    numbered = {e: i for i, e in enumerate(sorted(entries))}
    cutter = subwords.Cutter(numbered, mark, leading_space)
    assert cutter(text) == brute(text, numbered, mark, leading_space)
    assert cutter(text) == brute(text, numbered, mark, leading_space)  # from what it remembers


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([("▁the", 0), ("▁", 1), ("th", 2), ("in", 3), ("ing", 4), ("▁th", 5)], "token string, id int")


def test_tokens_of_a_table(spark, vocabulary):
    texts = spark.createDataFrame([(1, "the thing  xin"), (2, None), (3, ""), (3, "in"), (None, "the")], "k long, text string")
    got = subwords.tokens(texts, "k", vocabulary).collect()
    rows = sorted((str(r.k), r.token_no, r.token, r.id, r.start, r.end) for r in got)
    assert rows == sorted(
        [("1", 0, "▁the", 0, 0, 3), ("1", 1, "▁th", 5, 4, 6), ("1", 2, "ing", 4, 6, 9), ("1", 3, "▁", 1, 11, 11), ("1", 4, "x", None, 11, 12), ("1", 5, "in", 3, 12, 14)]
        + [("3", 0, "▁", 1, 0, 0), ("3", 1, "in", 3, 0, 2), ("None", 0, "▁the", 0, 0, 3)]
    )
    spaced = subwords.tokens(texts.where("k = 1"), "k", vocabulary, leading_space=True).collect()
    assert [(r.start, r.end) for r in sorted(spaced, key=lambda r: r.token_no)] == [(0, 3), (3, 6), (6, 9), (10, 11), (11, 12), (12, 14)]


def test_vocabulary_has_a_bound(spark, vocabulary):
    texts = spark.createDataFrame([(1, "the")], "k long, text string")
    with pytest.raises(ValueError):
        subwords.tokens(texts, "k", vocabulary, most=5)


def test_anchors_and_windows_of_subwords(spark, vocabulary):
    texts = spark.createDataFrame([(1, "the thing"), (2, "in the")], "k long, text string")
    tokens = subwords.tokens(texts, "k", vocabulary)
    anchors = spark.createDataFrame([(1, 5, 7), (2, 0, 1)], "k long, a_start int, a_end int")
    assert sorted(map(tuple, evaluate.overlaps(anchors, tokens, "k").collect())) == [(1, 1, 2), (2, 1, 1)]
    last = subwords.last_tokens(tokens, "k", 2).collect()
    assert sorted((r.k, r.token_no, r.token) for r in last) == [(1, 0, "▁th"), (1, 1, "ing"), (2, 0, "in"), (2, 1, "▁the")]


def test_missing_words(spark):
    words = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "word string")
    assert sorted(map(tuple, corpus.missing(words, words.where("word <> 'b'")).collect())) == [("b", 2)]


def test_tokens_leave_in_bounded_batches(spark, vocabulary, monkeypatch):
    """A worker's batches hold a bounded number of tokens, however long the texts are."""
    real, sizes = type(spark.range(0)).mapInArrow, []

    def watched(self, cut, schema):
        batch = pa.RecordBatch.from_pydict({"k": [1, 2], "text": ["the thing " * 40_000, "in"]})
        sizes.extend(b.num_rows for b in cut(iter([batch])))
        return real(self, cut, schema)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    texts = spark.createDataFrame([(1, "the")], "k long, text string")
    assert [r.token for r in subwords.tokens(texts, "k", vocabulary).collect()] == ["▁the"]
    assert sum(sizes) == 40_000 * 3 + 2 and max(sizes) <= 1 << 15


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(subwords, "REMEMBERED_CHARS", 1000)
    cutter = subwords.Cutter({"▁ab": 0, "ab": 1})
    words = [f"{i}" * 300 for i in range(10)] + ["abq", "qab"]
    assert [[p for p, *_ in cutter(w)] for w in words[-2:]] == [["▁ab", "q"], ["▁", "q", "ab"]]
    assert sum(len(cutter(w)) for w in words[:10]) == 10 * 301
    assert sum(map(len, cutter.seen)) <= 1000 and len(cutter.seen) == 5
    assert cutter.seen["abq"][1] is cutter.seen["qab"][1]  # one tuple for each unknown character
