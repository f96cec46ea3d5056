"""Alignment of two tokenizers by the bytes that their tokens cover.

The token numbers of A and of B are repeated over the bytes of a text (np.repeat), so that every byte names its owner on either side.
Consecutive distinct pairs of owners are the overlaps; where both owners change at once, both tokens end, and the text is cut into groups there. The
two tokens that end at a cut are linked.

How often a pair of ids is linked is counted over the corpus. One of two linked tokens is a suffix of the other, so the pairs that can
occur are bounded by the vocabularies (pair_bound()), whatever the corpus; their counts are broadcast behind a check of that bound.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, remembered, spread, stored, table
from .packing import RANKS, VOCABULARY, Ids
from .token_count import MODEL

#: Bytes of text that are aligned at a time; one text is never parted.
BLOCK = 1_000_000


class Tokens:
    """The bytes of each id of A, a byte-level vocabulary given by ranks, and of B, a SentencePiece model."""

    def __init__(self, ranks: str, model: str):
        with open(ranks, "rb") as f:
            rank = {int(n): base64.b64decode(token) for token, n in map(bytes.split, f)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.a_bytes = [rank.get(i, b"") for i in range(max(rank) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def pair_bound(self) -> int:
        """The most pairs of ids that can be linked: each token with those of the other side that are its suffixes or itself."""
        count_a, count_b = Counter(self.a_bytes), Counter(self.b_bytes)
        suffixes = lambda tokens, other: sum(other[t[i:]] for t in tokens for i in range(len(t)))
        return suffixes(self.a_bytes, count_b) + suffixes(self.b_bytes, count_a)


class Tokenizers(Tokens):
    """Both, able to encode."""

    def __init__(self, vocabulary: str, ranks: str, model: str):
        super().__init__(ranks, model)
        self.a = Ids(vocabulary, ranks)
        self.a.exact.encode_special_tokens = True  # their strings in a text are plain text

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A and B, none if their bytes aren't those of a space and the text."""
        nothing = np.zeros(0, np.int32)
        if not text:
            return nothing, nothing
        spaced = " " + text
        raw, a, b = spaced.encode(), self.a.of(spaced).astype(np.int32), self.b.encode(text, num_threads=1)
        # A's tokens spell what its pattern matches, so their bytes differ only if some are missing; B's model may change characters.
        same = int(self.a_size[a].sum()) == len(raw) and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return (a, np.array(b, np.int32)) if same else (nothing, nothing)


def tokens_of(paths: tuple[str, str, str]) -> Tokens:
    return remembered(("alignment-bytes", *paths), lambda: Tokens(*paths[1:]))


def cuts(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cut the numbers of the tokens of A and B that end there. The sizes are of the tokens of equal bytes, none empty; the last cut is the end."""
    a, b = np.repeat(np.arange(len(a_size)), a_size), np.repeat(np.arange(len(b_size)), b_size)
    at = np.flatnonzero(np.append((a[1:] != a[:-1]) & (b[1:] != b[:-1]), len(a) > 0))
    return a[at], b[at]


def overlaps(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the tokens of A and B that share bytes, a pair for each two, in order."""
    a, b = np.repeat(np.arange(len(a_size)), a_size), np.repeat(np.arange(len(b_size)), b_size)
    at = np.flatnonzero(np.append((a[1:] != a[:-1]) | (b[1:] != b[:-1]), len(a) > 0))
    return a[at], b[at]


def _packed(ids: list[np.ndarray]) -> tuple[pa.Array, bytes]:
    """How many ids each row has, and all of them, byte by byte and compressed."""
    flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype("<u4")
    return pa.array([len(x) for x in ids], pa.int32()), zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def _loose(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return planes.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def tokenised(docs: DataFrame, paths: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of A and B of all rows of docs, block by block: doc_ids, a_size and b_size by row of the block, a_ids and b_ids packed. unpacked() has a row for each row of docs.

    paths are of A's vocabulary, the same as ranks, and B's model, on every executor. A text that is null, empty or not what both sides'
    bytes spell has no ids. Rows that repeat are rows of their own, a null doc_id is passed on, other columns are not read, an empty table gives
    no rows. Texts are taken whole.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = remembered(("alignment", *paths), lambda: Tokenizers(*paths))
        for batch, texts in blocks(batches, size=BLOCK):
            got = [both.of(t) for t in texts]
            (a_size, a_ids), (b_size, b_ids) = (_packed([g[side] for g in got]) for side in (0, 1))
            whole = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), pa.concat_arrays([column]))
            yield pa.RecordBatch.from_arrays([whole(batch.column(0)), whole(a_size), whole(b_size), pa.array([a_ids], pa.binary()), pa.array([b_ids], pa.binary())], _BLOCKS)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id").mapInArrow(encode, f"doc_ids array<{dict(rows.dtypes)['doc_id']}>, a_size array<int>, b_size array<int>, a_ids binary, b_ids binary")


_BLOCKS = ["doc_ids", "a_size", "b_size", "a_ids", "b_ids"]


class _Block:
    """A row of tokenised(), aligned as one: ids of A and B, the tokens that end at each cut, and each document's part of all that."""

    def __init__(self, batch: pa.RecordBatch, row: int, both: Tokens):
        at = lambda name: batch.column(batch.schema.get_field_index(name))[row]
        self.doc_ids = at("doc_ids").values
        self.a, self.b = _loose(at("a_ids").as_py()), _loose(at("b_ids").as_py())
        self.sizes = both.a_size[self.a], both.b_size[self.b]
        self.a_end, self.b_end = cuts(*self.sizes)
        self.a_at, self.b_at = (np.append(0, np.cumsum(at(name).values.to_numpy(zero_copy_only=False), dtype=np.int64)) for name in ("a_size", "b_size"))
        self.cut_at = np.searchsorted(self.a_end, self.a_at)  # a document's end is a cut, as both sides end there

    def pairs(self) -> np.ndarray:
        """The links as numbers: A's id, then 32 bits for B's."""
        return self.a[self.a_end] << 32 | self.b[self.b_end]


def _blocks(batches: Iterator[pa.RecordBatch], both: Tokens) -> Iterator[_Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Block(batch, row, both)


def _kind(tokens: DataFrame) -> str:
    return tokens.schema["doc_ids"].dataType.elementType.simpleString()


def unpacked(tokens: DataFrame, paths: tuple[str, str, str], with_alignment: bool = False) -> DataFrame:
    """doc_id, a_ids and b_ids of each document of tokenised().

    with_alignment adds a_ends and b_ends, the numbers of the tokens that end each group, and a_over and b_over, those of each overlap, all from 0 in the document.
    """
    names = ["a_ids", "b_ids", *(["a_ends", "b_ends", "a_over", "b_over"] if with_alignment else [])]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, tokens_of(paths)):
            lists = [(block.a, None, block.a_at), (block.b, None, block.b_at)]
            if with_alignment:
                a, b = overlaps(*block.sizes)
                over_at = np.searchsorted(a, block.a_at)
                lists += [(block.a_end, block.a_at, block.cut_at), (block.b_end, block.b_at, block.cut_at), (a, block.a_at, over_at), (b, block.b_at, over_at)]
            inside = [numbers if first is None else numbers - np.repeat(first[:-1], np.diff(at)) for numbers, first, at in lists]
            columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x, (_, _, at) in zip(inside, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([block.doc_ids, *columns], ["doc_id", *names])

    return tokens.mapInArrow(unpack, f"doc_id {_kind(tokens)}, " + ", ".join(f"{n} array<int>" for n in names))


def link_counts(tokens: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """pair (A's id, then 32 bits for B's id) and n, how many links of all tokens hold it. Each task counts its own links first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()  # pair_bound() entries at most
        for block in _blocks(batches, tokens_of(paths)):
            pair, n = np.unique(block.pairs(), return_counts=True)
            total.update(dict(zip(pair.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

    return tokens.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_links(counts: DataFrame) -> DataFrame:
    """counts with best: whether no other pair of the same id of B is linked more often."""
    to = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(to.alias("_b")).agg(F.max("n").alias("_most"))
    return counts.withColumn("_b", to).join(most, "_b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def alignment_digests(tokens: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """For each document of tokens (see tokenised()): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best are the links of which no other pair of the same id of B has a higher count over all tokens, count_sum is the sum of the counts of all
    links. The hash is of the groups' ids, `a1,a2|b1;a3|b2`; a document without tokens has '' and zeros. tokens is read twice, so it should be a stored table.
    """
    table = best_links(link_counts(tokens, paths)).toArrow()
    bound = Tokens(*paths[1:]).pair_bound()
    if table.num_rows > bound:
        raise ValueError(f"{table.num_rows} pairs of ids are linked, {bound} can be")
    order = np.argsort(table.column("pair").to_numpy())
    known = tokens.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens_of(paths)
        pair, count, best = known.value
        # An id is spelled with what follows it: a comma, or where its group goes on or ends, a bar or a semicolon.
        a_text, b_text = (np.array([f"{i}{after}" for after in "," + end for i in range(n)], object) for end, n in (("|", len(both.a_size)), (";", len(both.b_size))))
        for block in _blocks(batches, both):
            at = np.searchsorted(pair, block.pairs())
            sums = [np.append(0, np.cumsum(x[at], dtype=np.int64))[block.cut_at] for x in (best, count)]
            n = np.diff(block.cut_at)
            numbers = [np.diff(block.a_at), np.diff(block.b_at), n, n, np.diff(sums[0]), np.diff(sums[1])]
            # A's tokens of a group stand before B's: a token's place is its number and how many of the other side lie before it.
            a_last, b_last = np.zeros(len(block.a), np.int64), np.zeros(len(block.b), np.int64)
            a_last[block.a_end] = b_last[block.b_end] = 1
            a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
            written = np.empty(len(block.a) + len(block.b), object)
            written[np.arange(len(block.a)) + np.append(0, block.b_end + 1)[a_group]] = a_text[block.a + a_last * len(both.a_size)]
            written[np.arange(len(block.b)) + (block.a_end + 1)[b_group]] = b_text[block.b + b_last * len(both.b_size)]
            starts = (block.a_at + block.b_at).tolist()
            hashes = [hashlib.sha256("".join(written[i:j].tolist())[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([block.doc_ids, *(pa.array(x, pa.int64()) for x in numbers), pa.array(hashes, pa.string())], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return tokens.mapInArrow(digest, f"doc_id {_kind(tokens)}, {', '.join(f'{n} long' for n in names[1:-1])}, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every whole text of documents, as counts and a digest; see tokenised() and alignment_digests() for nulls and repeats."""
    paths = tuple(map(public_tokenizers.path, (VOCABULARY, RANKS, MODEL)))
    return alignment_digests(stored(tokenised(table(spark, sf_dir, "documents"), paths), "alignment-ids"), paths)
