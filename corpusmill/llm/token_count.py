"""Token counts without token ids, for a SentencePiece model.

No piece of the model spans a boundary between a character and a following run of spaces, so a
text's count is the sum of the counts of its pre-tokens. Pieces are counted once for each distinct
pre-token of the corpus and joined to the pre-token frequencies of each document (words.py).
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import remembered, table
from .words import joined, split_blocks, worked

MODEL = "piece_bpe_32k.model"
LIMIT = 4096


@cache
def _model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, re.Pattern]:
    """The model and the pattern of its pre-tokens.

    A pre-token is a run of spaces with what follows up to the next one. It may also start at a
    line feed, if no piece holds one. A piece that goes on after a character with the space mark
    makes whole texts the pre-tokens.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)]
    if any(re.search("[^▁]▁", p) for p in pieces):
        return model, re.compile(r"(?s).+")
    if any("\n" in p for p in pieces):
        return model, re.compile(r"[ ▁]+[^ ▁]*|[^ ▁]+")
    return model, re.compile(r"[ ▁]+[^ ▁\n]*|\n[^ ▁\n]*|[^ ▁\n]+")


class Counter:
    """Counts the pieces of pre-tokens."""

    def __init__(self, path: str):
        self.model, self.pattern = _model(path)
        self.whole = self.pattern.pattern == "(?s).+"
        self.mark = 0 if self.whole else len(self.model.encode("\n")) - len("\n".encode())

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text that isn't empty."""
        return [text] if self.whole else self.pattern.findall(" " + text)

    def pieces(self, words: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token.

        The model sets a space mark before any text that it encodes. It stands for a pre-token's
        first space; before a line feed it is a piece by itself, which is taken off.
        """
        if self.whole:
            return np.array([len(x) for x in self.model.encode(words, num_threads=1)], np.int64)
        spaced = [w[0] in " ▁" for w in words]
        got = np.fromiter((len(ids) for ids in self.model.encode([w[1:] if s else w for w, s in zip(words, spaced, strict=True)], num_threads=1)), np.int64, len(words))
        for i, w in enumerate(words):
            if not spaced[i]:
                got[i] -= self.mark
            elif len(w) == 1:
                got[i] = 1
        return got

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of texts at hand."""
        return np.array([int(self.pieces(self.split(t)).sum()) if t else 0 for t in texts], np.int64)


def _counter(path: str) -> Counter:
    return remembered(("pieces", path), lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat are counted each by itself, a
    null doc_id is passed on, columns other than the two named ones are not read. Texts are taken
    whole; an empty table gives no rows. path must name the model's file on every executor.
    """

    def count(words: list[bytes]) -> list[bytes]:
        raw = _counter(path).pieces([w.decode() for w in words]).astype("<u8").tobytes()
        return [raw[i : i + 8] for i in range(0, len(raw), 8)]

    def finish(doc_ids: pa.Array, n_bytes: pa.Array, codes: list[np.ndarray], times: list[np.ndarray], values: list[bytes]) -> pa.Table:
        pieces = np.frombuffer(b"".join(values), "<i8")
        n = np.array([int(pieces[c] @ t.astype(np.int64)) for c, t in zip(codes, times, strict=True)], np.int64)
        return pa.table({"doc_id": doc_ids, "n_bytes": n_bytes, "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    table = split_blocks(docs, lambda: _counter(path).split, True, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return joined(worked(table, lambda: count), True, finish, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents; see token_counts() for nulls and repeats."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
