"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of the corpus (words.py) are laid out as arrays of symbols. An inverted index
leads from the rank of a token pair to the positions where the pair stands. Ranks are taken in
rising order; a merge is applied at all its positions with array operations and then looks only at
the two neighbours of each, whose new pairs enter the index. Every distinct pre-token of the corpus is encoded
once; its ids are joined back to the documents.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Codes, remembered, table
from .words import joined, split_blocks, worked

RANKS = "byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: \s of the library's patterns: Unicode White_Space. Python's also takes U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pretokens(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The pattern with \\s and \\S as White_Space."""
    inside = regex.sub(r"\[\^((?:[^\]\\]|\\.)*)\]", lambda m: "[^" + m[1].replace(r"\s", WHITE) + "]", pattern)
    return regex.compile(inside.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class Ranks:
    """Tokens by rank, and the rank of a pair of tokens from a table probed with array operations."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at, self.probes = self._slot(keys), 0
        while len(keys):
            free = self.key[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            put = free & first
            self.key[at[put]], self.value[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.key) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each a + b, NONE where that is no token."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        got = np.where(self.key[at] == keys, self.value[at], NONE)
        open_ = np.flatnonzero((got == NONE) & (self.key[at] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.key) - 1)
            there = self.key[at[open_]]
            hit = there == keys[open_]
            got[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return got


def _merged(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of the sorted positions of one pair those that merge from left to right: of a chain of overlapping ones every other."""
    chained = np.zeros(len(at), bool)
    chained[1:] = after[at[:-1]] == at[1:]
    first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - first) % 2 == 0]


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all words in a row, and where each word's ids start (one more for the end).

    As the library does it, a word that is itself a token is that token. All positions of a rank are merged at once. If one of these
    merges brings up a pair of lower rank, that word's positions to its right wait until the lower pair has had its turn.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = int(lengths.sum())
    symbol = ranks.byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    full = lengths > 0
    after[ends[full] - 1] = -1
    before[starts[full]] = -1
    alive = np.ones(n, bool)
    whole = np.fromiter((ranks.rank.get(w, -1) for w in words), np.int32, len(words))
    done = np.flatnonzero((whole >= 0) & full)
    alive[:] = ~np.isin(word, done) if len(done) else True
    alive[starts[done]], symbol[starts[done]], after[starts[done]] = True, whole[done], -1

    rank = np.full(n + 1, NONE, np.int32)
    left = np.flatnonzero(alive & (after >= 0))
    rank[left] = ranks.pair(symbol[left], symbol[after[left]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, r: np.ndarray) -> None:
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        edges = [0, *cuts.tolist(), len(r)]
        for k, i, j in zip(r[[0, *cuts]].tolist(), edges, edges[1:]):
            if k in index:
                index[k].append(at[i:j])
            else:
                index[k] = [at[i:j]]
                heapq.heappush(heap, k)

    left = left[rank[left] != NONE]
    enter(left, rank[left])
    while heap:
        r = heapq.heappop(heap)
        at = index.pop(r)
        at = np.concatenate(at) if len(at) > 1 else at[0]
        at = np.sort(at[rank[at] == r])
        if not len(at):
            continue
        if len(at) > 1:
            at = at[np.append(True, at[1:] != at[:-1])]
        every = at
        at = _merged(at, after)
        right = after[at]
        beyond, behind = after[right], before[at]
        old = symbol[at].copy()
        # The pair to the right as it is when its turn comes: what follows isn't merged yet.
        follows = np.full(len(at), NONE, np.int32)
        there = np.flatnonzero(beyond >= 0)
        follows[there] = ranks.pair(np.full(len(there), r, np.int32), symbol[beyond[there]])
        symbol[at] = r
        beside = behind.copy()
        beside[1:] = np.where(behind[1:] == right[:-1], at[:-1], behind[1:])  # merged just before
        leads = np.full(len(at), NONE, np.int32)
        there = np.flatnonzero(beside >= 0)
        leads[there] = ranks.pair(symbol[beside[there]], np.full(len(there), r, np.int32))
        lower = np.flatnonzero((follows < r) | (leads < r))
        if len(lower):
            w = word[at]
            hit, first = np.unique(w[lower], return_index=True)
            stop = np.full(len(words), len(at))
            stop[hit] = lower[first]
            now = np.arange(len(at)) <= stop[w]
            symbol[at[~now]] = old[~now]
            index[r] = [every]  # those merged now lose the rank
            heapq.heappush(heap, r)
            at, right, beyond, behind = at[now], right[now], beyond[now], behind[now]
        alive[right], rank[right], rank[at] = False, NONE, NONE
        after[at] = beyond
        there = beyond >= 0
        before[beyond[there]] = at[there]
        a = at[there]
        p = before[at]
        p = p[p >= 0]
        near = np.concatenate([a, p])
        near = near[after[near] >= 0]
        got = ranks.pair(symbol[near], symbol[after[near]])
        rank[near] = got
        new = got != NONE
        enter(near[new], got[new])
    counts = np.bincount(word[alive], minlength=len(words))
    return symbol[alive], np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    """Encodes pre-tokens and decodes ids."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.text = [str(i) for i in range(len(self.ranks.token))]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit numbers."""
        found, starts = replay(words, self.ranks)
        raw, at = found.astype("<u4").tobytes(), (4 * starts).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts at hand, each of their distinct pre-tokens encoded once."""
        codes, find = Codes(), pretokens().findall
        held = [codes.of(find(t)).tolist() for t in texts]
        raws = self.ids([w.encode() for w in codes]) if codes else []
        return [np.frombuffer(b"".join(map(raws.__getitem__, c)), "<u4").astype(np.int32) for c in held]

    def spelled(self, raw: bytes) -> str:
        """The decimal ids joined by one space."""
        return " ".join(map(self.text.__getitem__, np.frombuffer(raw, "<u4").tolist()))

    def decoded(self, raw: bytes | np.ndarray) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, np.frombuffer(raw, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    return remembered(("byte-bpe", path), lambda: Encoder(path))


def _split() -> Callable[[str], list[str]]:
    return pretokens().findall


def _joined(docs: DataFrame, path: str, finisher: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    table = split_blocks(docs, _split, False, id_col, text_col)
    return joined(worked(table, lambda: encoder(path).ids), False, finisher, schema)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids (array of int) of each row of docs.

    Null texts count as empty, rows that repeat are encoded each by itself, a null doc_id is passed on, columns other than the
    two named ones are not read, an empty table gives no rows.
    """

    def finish(doc_ids: pa.Array, n_bytes: pa.Array, codes: list[np.ndarray], times: list, raws: list[bytes]) -> pa.Table:
        out = [np.frombuffer(b"".join(map(raws.__getitem__, of.tolist())), "<i4") for of in codes]
        return pa.table({"doc_id": doc_ids, "ids": pa.array(out, pa.list_(pa.int32()))})

    return _joined(docs, path, finish, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>", id_col, text_col)


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes that each row's ids stand for; null ids give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            got = [coder.decoded(np.array(x or [], "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["doc_id", "bytes"])

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decode, f"doc_id {dict(rows.dtypes)['doc_id']}, bytes binary")


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs, without ids leaving the task.

    The first hash is of the decimal ids joined by one space, the second of the bytes that decoding
    the ids gives. Null and empty texts have no tokens and the hashes of no bytes. Rows that repeat
    are encoded each by itself, a null doc_id is passed on, other columns are not read.
    """

    def finish(doc_ids: pa.Array, n_bytes: pa.Array, codes: list[np.ndarray], times: list, raws: list[bytes]) -> pa.Table:
        coder = encoder(path)
        spelled, back = list(map(coder.spelled, raws)), list(map(coder.decoded, raws))
        size = np.fromiter((len(r) // 4 for r in raws), np.int64, len(raws))
        n, written, bytes_ = [], [], []
        for of in codes:
            at = of.tolist()
            n.append(int(size[of].sum()))
            written.append(hashlib.sha256(" ".join(map(spelled.__getitem__, at)).encode()).hexdigest())
            bytes_.append(hashlib.sha256(b"".join(map(back.__getitem__, at))).hexdigest())
        return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(written, pa.string()), "decoded_sha256": pa.array(bytes_, pa.string())})

    kind = docs.schema[id_col].dataType.simpleString()
    return _joined(docs, path, finish, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents, as counts and digests; see encoding_digests() for nulls and repeats."""
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
