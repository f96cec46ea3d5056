"""Longest-match subword tokens over a vocabulary table, with their places in the text.

A word is what stands between white space. Behind a mark (for the space before it, as in many vocabularies) it is cut from left to right, each time
at the longest entry of the vocabulary that fits; a character that no entry begins with is a token by itself, without an id. The entries lie in a trie
that each worker makes once, and a worker remembers how it cut the words that it has seen. Tokens leave a worker in batches of a fixed number of rows, a long
text's in several.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a vocabulary at most: it is broadcast.
MOST = 1_000_000
#: Words and characters of words that a worker remembers.
REMEMBERED, REMEMBERED_CHARS = 200_000, 4 << 20
#: Tokens that a worker gives out at a time.
TOGETHER = 1 << 15
_WORD = re.compile(r"\S+")


class Trie:
    """Entries with their ids, found by their longest match."""

    def __init__(self, entries: dict[str, int]):
        self.root: dict = {}
        self.unknown: dict[str, tuple[str, None]] = {}
        for entry, number in entries.items():
            node = self.root
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = (entry, number)

    def cut(self, word: str) -> list[tuple[str, int | None]]:
        """The tokens of a word and their ids."""
        got, at = [], 0
        while at < len(word):
            node, found = self.root, None
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                found = node.get("", found)
            if found is None:
                found = self.unknown.get(word[at]) or self.unknown.setdefault(word[at], (word[at], None))
            got.append(found)  # the entry's or character's own tuple: what a worker remembers takes little room
            at += len(got[-1][0])
        return got


class Cutter:
    """Cuts texts into tokens with their places, start and end, half open and in characters.

    The mark that a word begins with covers no character, or with leading_space the white space before the word, if there is any.
    """

    def __init__(self, entries: dict[str, int], mark: str = "▁", leading_space: bool = False):
        self.trie, self.mark, self.leading_space = Trie(entries), mark, leading_space
        self.seen: dict[str, list[tuple[str, int | None]]] = {}
        self.room = REMEMBERED_CHARS

    def __call__(self, text: str) -> list[tuple[str, int | None, int, int]]:
        return list(self.each(text))

    def each(self, text: str) -> Iterator[tuple[str, int | None, int, int]]:
        for m in _WORD.finditer(text):
            pieces = self.seen.get(m[0])
            if pieces is None:
                pieces = self.trie.cut(self.mark + m[0])
                if len(self.seen) < REMEMBERED and len(m[0]) <= self.room:
                    self.seen[m[0]] = pieces
                    self.room -= len(m[0])
            first = m.start() - (1 if self.leading_space and m.start() else 0)
            at = m.start() - len(self.mark)  # where the mark would stand if it took up room
            for piece, number in pieces:
                end = at + len(piece)
                yield piece, number, max(at, m.start()) if at >= m.start() else first, max(end, m.start())
                at = end


_held: list = []


def _cutter(entries: dict[str, int], mark: str, leading_space: bool) -> Cutter:
    """The worker's one cutter: made anew for other entries than those that it holds."""
    if not _held or _held[0] is not entries or _held[1:3] != [mark, leading_space]:
        _held[:] = [entries, mark, leading_space, Cutter(entries, mark, leading_space)]
    return _held[3]


def tokens(texts: DataFrame, key: str, vocabulary: DataFrame, text: str = "text", mark: str = "▁", leading_space: bool = False, most: int = MOST) -> DataFrame:
    """key, token_no (from 0), token, id (null if the vocabulary lacks it), start and end of each token of each text; null texts have none.

    vocabulary has token and id, each token once, and most rows at most, or it is an error.
    """
    held = vocabulary.select("token", "id").limit(most + 1).toArrow()
    if held.num_rows > most:
        raise ValueError(f"the vocabulary has more than {most} entries")
    shared = texts.sparkSession.sparkContext.broadcast(dict(zip(held.column("token").to_pylist(), held.column("id").to_pylist(), strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(shared.value, mark, leading_space)
        for batch in batches:
            keys, held, rows, places = batch.column(0), batch.column(1), [], []

            def given() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "token_no", "token", "id", "start", "end"])

            for i in range(len(held)):
                for k, token in enumerate(cutter.each(held[i].as_py() or "")):
                    rows.append((k, *token))
                    places.append(i)
                    if len(rows) == TOGETHER:
                        yield given()
                        rows, places = [], []
            if rows:
                yield given()

    kind = dict(texts.dtypes)[key]
    got = texts.select(key, text).mapInArrow(cut, f"key {kind}, token_no int, token string, id int, start int, end int")
    return got.withColumnRenamed("key", key)


def last_tokens(tokens: DataFrame, key: str, n: int) -> DataFrame:
    """The last n tokens of each text, numbered anew from 0: what a scorer with a window of n sees of longer texts."""
    size = tokens.groupBy(key).agg((F.max("token_no") + 1).alias("_size"))
    first = F.greatest(F.col("_size") - n, F.lit(0))
    return tokens.join(size, key).where(F.col("token_no") >= first).withColumn("token_no", F.col("token_no") - first).drop("_size")
