"""Packing by power-of-two decomposition.

A document of n tokens is cut into n // 2048 pieces of 2048 tokens and one piece for each binary
digit of what is left, longest first. Each piece is a sequence by itself: its length is a power of
two, so it needs no padding, and no sequence crosses documents. Sequences of equal length form a
bucket, from which batches of one shape can be drawn.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, remembered, spread, table

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"
END = 1
LENGTH = 2048
#: Characters that every Unicode version classes alike; a text with others, or with the special
#: token's string, is left to the vocabulary's own library.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|<\\|endoftext\\|>")


class Ids:
    """The ids that tokenizers gives for byte_bpe_50k.json, mostly by way of the faster rank library."""

    def __init__(self, vocabulary: str, ranks: str):
        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if _OTHER.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def _ids(vocabulary: str, ranks: str) -> Ids:
    return remembered(("ids", vocabulary, ranks), lambda: Ids(vocabulary, ranks))


def piece_lengths(n: int, longest: int = LENGTH) -> list[int]:
    """The lengths of the pieces of n tokens, longest first; longest is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame, vocabulary: str, ranks: str, longest: int = LENGTH, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and ids if asked for.

    end follows each document's ids, so an empty or null text is a piece of one token. sequence_id is
    unique over the result: the task's number and a running number in it. bucket is the binary
    logarithm of length. Rows that repeat are packed each by itself, a null doc_id is passed on,
    columns other than the two named ones are not read. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, made = _ids(vocabulary, ranks), TaskContext.get().partitionId() << 36, 0
        for batch, texts in blocks(batches):
            row, start, length, crc, total, raws = [], [], [], [], [], []
            for i, text in enumerate(texts):
                got = np.append(ids.of(text), np.uint32(end)).astype("<u4")
                raw, at = got.tobytes(), 0
                for n in piece_lengths(len(got), longest):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(got))
                    if with_ids:
                        raws.append(got[at : at + n].astype(np.int32))
                    at += n
            n = len(row)
            sequence = np.arange(made, made + n, dtype=np.int64) + task
            made += n
            size = np.array(length, np.int64)
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(total, pa.int64()),
                pa.array(sequence), pa.array(np.zeros(n, np.int64)), pa.array(np.log2(np.maximum(size, 1)).astype(np.int32)),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                columns.append(pa.array(raws, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
    return spread(rows, "doc_id").mapInArrow(cut, schema + ", ids array<int>" * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))
