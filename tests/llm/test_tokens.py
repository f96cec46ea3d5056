"""Token counts, encoding and packing against the libraries."""

from __future__ import annotations

import base64
import hashlib
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import byte_bpe, packing, token_count

TEXTS = ["", " ", "  a", "a ", "\n", "\n\n a", "▁", "▁▁a ▁", "<s></s>", "<0x0A>", "<|endoftext|>x", "it's 12 \t\n", "\x1c \x1f\x85  　", "a" * 5000, "!?" * 3000, " " * 2000, "日本語 🙂 текст", "²½ ñéß"]
MIX = st.text(alphabet=st.one_of(st.sampled_from("aabbc  \n\t'sd.,!<>|▁é€中🙂\x1c\x85²"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=P.path(token_count.MODEL)), token_count.Counter(P.path(token_count.MODEL))


@pytest.fixture(scope="module")
def ranks():
    with open(P.path(byte_bpe.RANKS), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={}), byte_bpe.Encoder(P.path(byte_bpe.RANKS))


@pytest.fixture(scope="module")
def vocabulary():
    return Tokenizer.from_file(P.path(packing.VOCABULARY)), packing.Ids(P.path(packing.VOCABULARY), P.path(packing.RANKS))


def test_piece_counts(pieces):
    model, counter = pieces
    assert counter.counts(TEXTS).tolist() == [len(model.encode(t)) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(MIX, max_size=6))
def test_piece_counts_of_any_text(pieces, texts):
    model, counter = pieces
    assert counter.counts(texts).tolist() == [len(model.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(MIX, max_size=6))
def test_merge_replay_of_any_text(ranks, texts):
    library, coder = ranks
    ids = coder.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [coder.decoded(x.astype("<u4")) for x in ids] == [t.encode() for t in texts]


def test_merge_replay_where_ranks_fall(ranks):
    """A rank table in which a merge brings up a pair of lower rank."""
    _, coder = ranks
    assert [x.tolist() for x in coder.encode(TEXTS)] == [ranks[0].encode_ordinary(t) for t in TEXTS]


@pytest.mark.parametrize("word", ["a" * 1_000_000, "ab" * 500_000, "".join(np.random.default_rng(5).choice(list("ABCDEFGHabcdefgh0123+/"), 1_000_000))])
def test_merge_replay_of_a_long_word(ranks, word):
    """Words of a megabyte take seconds; the ids are the library's."""
    began = time.time()
    got = ranks[1].ids([word.encode()])[0]
    assert time.time() - began < 60
    assert np.frombuffer(got, "<u4").tolist() == ranks[0]._encode_single_piece(word)


def test_merge_replay_in_a_small_vocabulary(tmp_path):
    """Random vocabularies whose ranks don't rise with length."""
    rng = np.random.default_rng(3)
    for k in range(15):
        words = {bytes([b]) for b in range(256)} | {bytes(rng.integers(97, 100, rng.integers(2, 6)).tolist()) for _ in range(60)}
        order = [bytes([b]) for b in range(256)] + sorted((w for w in words if len(w) > 1), key=lambda w: rng.random())
        path = tmp_path / f"{k}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(w) + b" " + str(i).encode() + b"\n" for i, w in enumerate(order)))
        library = tiktoken.Encoding(f"t{k}", pat_str=P.PATTERN, mergeable_ranks={w: i for i, w in enumerate(order)}, special_tokens={})
        coder = byte_bpe.Encoder(str(path))
        texts = ["".join(rng.choice(list("abc "), 40)) for _ in range(60)] + ["abcabc" * 60]
        assert [x.tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(MIX)
def test_packing_ids_of_any_text(vocabulary, text):
    exact, ids = vocabulary
    assert ids.of(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_packing_ids_of_every_character(vocabulary):
    """The class of characters that goes to the rank library, one code point at a time and beside letters, digits and spaces."""
    exact, ids = vocabulary
    inside = [chr(c) for c in range(0x20D0) if not packing._OTHER.search(chr(c))]
    assert len(inside) > 600
    for ch in inside:
        for text in (ch, f"a{ch}b", f"1{ch}2", f" {ch} ", f"{ch}{ch}", f"\n{ch}'s"):
            assert ids.of(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_piece_lengths():
    for n in [1, 2, 3, 5, 2047, 2048, 2049, 10_000]:
        got = packing.piece_lengths(n)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in got)
        assert len(set(x for x in got if x < 2048)) == len([x for x in got if x < 2048])


def test_token_counts_operator(odd_docs, no_docs, pieces):
    got = token_count.token_counts(odd_docs, P.path(token_count.MODEL), limit=10)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), n := len(pieces[0].encode(r["text"] or "")), n > 10) for r in odd_docs.collect())
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect()) == want
    assert token_count.token_counts(no_docs, P.path(token_count.MODEL)).count() == 0


def test_byte_bpe_operator(odd_docs, no_docs, ranks):
    path = P.path(byte_bpe.RANKS)
    got = byte_bpe.encoding_digests(odd_docs, path)
    want = []
    for r in odd_docs.collect():
        ids = ranks[0].encode_ordinary(r["text"] or "")
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect()) == sorted(want)
    assert byte_bpe.encoding_digests(no_docs, path).count() == 0
    back = byte_bpe.decoded(byte_bpe.encoded(odd_docs, path), path)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((r["text"] or "").encode() for r in odd_docs.collect())


def check_pieces(rows: pd.DataFrame, texts: dict, exact: Tokenizer) -> None:
    assert rows.sequence_id.is_unique and (rows.offset == 0).all()
    assert set(rows.doc_id) == set(texts)
    for doc, part in rows.groupby("doc_id"):
        ids = np.array(exact.encode(texts[doc], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in part.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and 1 << r.bucket == r.length
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_operator(spark, odd_docs, no_docs, vocabulary):
    paths = P.path(packing.VOCABULARY), P.path(packing.RANKS)
    named = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in named.collect()}
    check_pieces(packing.pack(named, *paths).toPandas(), texts, vocabulary[0])
    whole = packing.pack(odd_docs, *paths, with_ids=True)
    assert whole.where("doc_id is null").count() > 0 and whole.where("size(ids) <> length").count() == 0
    assert packing.pack(no_docs, *paths).count() == 0


def test_packing_query(spark, sf, vocabulary):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    check_pieces(packing.op8_packing(spark, sf).toPandas(), dict(zip(docs.doc_id, docs.text)), vocabulary[0])


def test_counts_and_encoding_queries(spark, sf, pieces, ranks):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    got = token_count.op3_token_counts(spark, sf).toPandas().set_index("doc_id")
    assert all(got.n_tokens[i] == len(pieces[0].encode(t)) and got.n_bytes[i] == len(t.encode()) for i, t in docs.items())
    got = byte_bpe.op9_byte_bpe(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and all(got.n_tokens[i] == len(ranks[0].encode_ordinary(t)) for i, t in docs.items())
    ids = {i: ranks[0].encode_ordinary(t) for i, t in docs.items()}
    assert all(got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for i, x in ids.items())
    assert all(got.decoded_sha256[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items())
