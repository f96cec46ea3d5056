"""Language identification of mixed-language text.

Script ranges say which learned languages a word may belong to; trigrams of characters score the
word for each of those; the Viterbi path over the words of a text, with a penalty for each switch
of language, labels its spans. Each distinct word is scored once for a block of documents.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, MEMO_WORDS, Codes, blocks, by_hash, parts, remembered, spread, table

#: Labelled documents of each language that a model is fitted on, about.
FIT_ROWS = 3000
#: What a change of language between two words costs, in nats.
SWITCH = 16.0
#: Added to each count of a trigram.
SMOOTH = 0.1
BUCKETS = 1 << 16
#: The share of its letters that a document's language must have for the pipeline.
LEAST_SHARE = 0.5
#: First and last code point of the main blocks of scripts; all else is script 0.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)
_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


def _marks() -> str:
    """The combining marks as ranges of a character class."""
    got, first = [], None
    for c in range(0x300, 0xE01F1):
        mark = c < 0xE01F0 and unicodedata.category(chr(c))[0] == "M"
        if mark and first is None:
            first = c
        elif not mark and first is not None:
            got.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(got)


#: A letter with the letters and combining marks after it.
_WORD = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")


def _script_table() -> np.ndarray:
    got = np.zeros(0x10000, np.int8)
    for name, first, last in SCRIPTS:
        got[first : last + 1] = _NAMES.index(name)
    return got


_SCRIPT = _script_table()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed trigrams of all words in a row, one around each character; whose each is; each word's script."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.flatnonzero(points[1:-1] != 32) + 1
    owner = np.cumsum(points == 32)[inside] - 1
    a, b, c = (points[inside + k].astype(np.uint64) for k in (-1, 0, 1))
    mixed = ((a * np.uint64(0x100000001B3) + b) * np.uint64(0x100000001B3) + c) * np.uint64(0x9E3779B97F4A7C15)
    first = points[inside[np.searchsorted(owner, np.arange(len(words)))]]
    script = np.where(first < 0x10000, _SCRIPT[np.minimum(first, 0xFFFF)], 0).astype(np.int64)
    return (mixed >> np.uint64(48)).astype(np.int64), owner, script


@dataclass
class Model:
    """Scores of hashed trigrams (BUCKETS x languages) and the scripts each language is written in."""

    langs: list[str]
    scores: np.ndarray
    writes: np.ndarray  # scripts x languages
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Words:
    """A model's scores of the words seen so far."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.codes, self.score, self.letters = Codes(), np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int64)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > MEMO_WORDS:
            self.forget()
        find, of = _WORD.findall, self.codes.of
        got = [of(find(t.lower())) for t in texts]
        scores, letters = [self.score], [self.letters]
        for new in parts(self.codes.since(len(self.score))):
            score, n = self.scored(new)
            scores.append(score)
            letters.append(n)
        self.score, self.letters = np.concatenate(scores), np.concatenate(letters)
        return got

    def scored(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and number of letters of words."""
        grams, owner, script = trigrams(new)
        rows = self.model.scores[grams]
        starts = np.searchsorted(owner, np.arange(len(new)))
        score = np.add.reduceat(rows, starts, axis=0)
        may = self.model.writes[script]
        may = may | ~may.any(axis=1, keepdims=True)
        score = np.where(may, score, score.min(axis=1, keepdims=True) - np.float32(1000))
        letters = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new), np.int64, len(new))
        score[letters == 0] = 0
        return score.astype(np.float32), letters


def _words(model: Model) -> Words:
    return remembered(("language", model.key), lambda: Words(model))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of scores, for texts of the given lengths in a row.

    All texts advance together, the longest first, so that the ones still going are the first ones.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    size_up = -size
    longest = int(size[0]) if len(size) else 0
    best = np.zeros((len(size), scores.shape[1]))
    turned = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), np.int16)
    for t in range(longest):
        k = int(np.searchsorted(size_up, -t))
        v, at = best[:k], begin[:k] + t
        if t:
            j = v.argmax(axis=1)
            through = v[np.arange(k), j][:, None] - switch
            turned[at], came[at] = v < through, j
            np.maximum(v, through, out=v)
        v += scores[at]
    label, state = np.zeros(len(scores), np.int16), best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = int(np.searchsorted(size_up, -t))
        at, s = begin[:k] + t, state[:k]
        label[at] = s
        if t:
            state[:k] = np.where(turned[at, s], came[at], s)
    return label


def _labelled(words: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label and letters of every word of the texts, and the number of words of each text."""
    codes = words.of(texts)
    lengths = np.fromiter(map(len, codes), np.int64, len(codes))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    return viterbi(words.score[flat], lengths), words.letters[flat], lengths


def judged(words: Words, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language with most letters and its share of the letters, und and 0 for a text without a letter."""
    n = len(words.model.langs)
    if not n:
        return ["und"] * len(texts), np.zeros(len(texts))
    label, letters, lengths = _labelled(words, texts)
    text = np.repeat(np.arange(len(texts)), lengths)
    held = np.bincount(text * n + label, weights=letters, minlength=n * len(texts)).reshape(len(texts), n)
    total = held.sum(axis=1)
    names = np.array(words.model.langs, object)
    return np.where(total > 0, names[held.argmax(axis=1)], "und").tolist(), held.max(axis=1) / np.maximum(total, 1)


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """A model from about rows documents of each language, chosen by hash of id; rows without language, id or text are not learned from."""
    rest = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("doc_id is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rest.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(float(min(1.0, rows / sizes[lang])))).otherwise(share)
    sample = rest.where("text is not null").where(by_hash("doc_id", "language-fit") < share * F.lit(float(1 << 31)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(langs)}
        held = np.zeros((len(langs), BUCKETS + len(_NAMES)), np.int64)
        for batch, texts in blocks(batches):
            for text, lang in zip(texts, batch.column(0).to_pylist(), strict=True):
                if words := _WORD.findall(text.lower()):
                    grams, _, script = trigrams(words)
                    held[number[lang]] += np.bincount(np.append(grams, script + BUCKETS), minlength=held.shape[1])
        lang, feature = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(held[lang, feature])], ["lang", "feature", "n"])

    counts = spread(sample.select("lang", "text", "doc_id"), "doc_id").mapInArrow(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    held[counts.feature, counts.lang] = counts.n
    grams, scripts = held[:BUCKETS] + SMOOTH, held[BUCKETS:]
    scores = np.log(grams / grams.sum(axis=0, keepdims=True)).astype(np.float32)
    return Model(langs, scores, scripts > 0.01 * np.maximum(1, scripts.sum(axis=0, keepdims=True)))


def _size(model: Model) -> int:
    return BLOCK_CHARS * 4 // max(4, len(model.langs))


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row of docs.

    lang_pred is the language with most letters on the best path, the alphabetically first of equals; und with score 0 if
    the text is null or has no letter, or no language was learned. score is that language's share of the letters.
    Only the two named columns are read; repeated rows are judged each by itself, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(shared.value)
        for batch, texts in blocks(batches, size=_size(shared.value)):
            lang, score = judged(words, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id").mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (start, end, lang) of each row of docs, in characters; a span goes from its first word to its last. Null texts and texts without a letter have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(shared.value)
        for batch, texts in blocks(batches, size=_size(shared.value)):
            if shared.value.langs:
                labels, _, lengths = _labelled(words, texts)
            else:
                labels, lengths = np.zeros(0, int), np.zeros(len(texts), int)
            out, at = [], 0
            for text, n in zip(texts, lengths.tolist(), strict=True):
                got: list[dict] = []
                for m, k in zip(_WORD.finditer(text.lower()), labels[at : at + n].tolist(), strict=False):
                    lang = shared.value.langs[k]
                    if got and got[-1]["lang"] == lang:
                        got[-1]["end"] = m.end()
                    else:
                        got.append({"start": m.start(), "end": m.end(), "lang": lang})
                out.append(got)
                at += n
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id").mapInArrow(label, f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<start:long,end:long,lang:string>>")


def in_a_language(docs: DataFrame, model: Model, least: float = LEAST_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language has at least least of the letters; all columns stay. Null texts and texts without a letter go; repeats go or stay alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(shared.value)
        for batch, texts in blocks(batches, text=text_col, size=_size(shared.value)):
            lang, score = judged(words, texts)
            yield batch.filter(pa.array((np.array(lang, object) != "und") & (score >= least)))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents; see predicted() for nulls and repeats."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
