"""Quality classifier: supervised subword embeddings.

A document's features are, for each white-space word, the word itself, its character n-grams with
word ends, and the word n-gram of two with the word before it. Each is hashed to a row of a table of learned
vectors. The document is the mean of its features' vectors; a softmax layer on it gives the score.
Table and layer are trained together by stochastic gradient descent in numpy. The sample has the classes in other proportions than the
labels; the offset is corrected for that (log of the sampling rates), so scores are calibrated to the labels at every size.

The output layer is linear, so a fitted model carries each row's two logits; the sum of a word's
logits is worked out once for each distinct word of a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_WORDS, Codes, blocks, by_hash, parts, remembered, spread, stored, table

#: Labelled documents of each class that a model is fitted on, at most.
FIT_ROWS = 2000
DIM, BITS, EPOCHS, RATE, SEED = 8, 18, 6, 0.5, 1
#: Steps of the training at least: a small sample is gone through more often.
STEPS = 6000
GRAMS = (2, 3, 4)
#: Times the rate for the vectors, whose gradients are spread over hundreds of features.
SPEED = 20.0
THRESHOLD = 0.3
_P = np.uint64(0x9E3779B97F4A7C15)
_DOWN = np.uint64(64 - BITS)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * _P >> _DOWN).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all words' features in a row, whose each is, and a hash of each word."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.cumsum(points == 10) - 1
    ends = np.flatnonzero(points == 10)
    rows, whose = [], []
    h, prefix = points.copy(), np.zeros(len(points) + 1, np.uint64)
    for n in range(2, max(GRAMS) + 1):
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in GRAMS:  # a gram of word w starts at its left end or inside, and reaches its right end at most
            at = np.arange(len(h))
            fits = at + n - 1 <= ends[np.minimum(owner[at] + 1, len(ends) - 1)]
            at = at[fits & (owner[at] < len(words))]
            rows.append(_bucket(h[at] + np.uint64(n)))
            whose.append(owner[at])
    place = (np.arange(len(points)) - ends[np.maximum(owner, 0)]).astype(np.uint64)
    mixed = (points * _P) ^ (place * np.uint64(0x94D049BB133111EB))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    np.cumsum(mixed ^ (mixed >> np.uint64(32)), out=prefix[1:])
    length = np.diff(ends).astype(np.uint64)
    hashes = (prefix[ends[1:]] - prefix[ends[:-1]]) * np.uint64(0xBF58476D1CE4E5B9) + length
    rows.append(_bucket(hashes ^ np.uint64(0x5555)))
    whose.append(np.arange(len(words)))
    return np.concatenate(rows), np.concatenate(whose), hashes


def pair_rows(hashes: np.ndarray) -> np.ndarray:
    """The rows of the pairs of neighbouring words; all pairs of equal words share one row."""
    a, b = hashes[:-1], hashes[1:]
    return np.where(a == b, 0, _bucket((a * np.uint64(0x100000001B3)) ^ (b * _P)))


@dataclass
class Model:
    """Logits of class 1 over class 0 by row, times one, and the offset."""

    logits: np.ndarray
    offset: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the whole text's features with how often each stands there."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    codes = Codes()
    at = codes.of(words)
    rows, whose, hashes = word_features(list(codes))
    times = np.bincount(at, minlength=len(codes))
    every = np.bincount(np.append(rows, pair_rows(hashes[at])), weights=np.append(times[whose], np.ones(len(at) - 1)))
    kept = np.flatnonzero(every)
    return kept.astype(np.int32), every[kept].astype(np.float32)


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features' rows and their shares of the text, in half precision as thousands of texts are held."""
    rows, times = document_features(text)
    return rows, (times / max(1, times.sum()) if len(rows) else times).astype(np.float16)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors (rows x DIM), softmax weights (2 x DIM) and offsets (2) from documents' rows and shares, by gradient descent one document at a time."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights, offset = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // max(1, len(docs))))
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rows, share = docs[i]
            rate = RATE * (1 - step / steps)
            step += 1
            share = share.astype(np.float32)
            mean = share @ vectors[rows] if len(rows) else np.zeros(DIM, np.float32)
            z = weights @ mean + offset
            p = np.exp(z - z.max())
            error = (p / p.sum()).astype(np.float32)
            error[labels[i]] -= 1
            down = error @ weights
            weights -= np.float32(rate) * np.outer(error, mean)
            offset -= np.float32(0.1 * rate) * error
            if len(rows):
                vectors[rows] -= np.float32(rate) * share[:, None] * down * np.float32(SPEED)
    return vectors, weights, offset


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of label 1 against 0 from at most rows documents of each, those of the smallest hashes of doc_id.

    Labels that are null or neither 0 nor 1 are left out, as are labels without a document; of repeated labels
    of a document the smallest counts. Without documents of both classes the model gives every text the same score.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    known = stored(known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi"), "quality-labels")
    chosen = None
    for label in (0, 1):
        one = known.where(F.col("_label") == label).withColumn("_hash", by_hash("_id", "quality-fit")).orderBy("_hash", "_id").limit(rows)
        chosen = one if chosen is None else chosen.unionByName(one)
    chosen = stored(chosen.select("_id", "_label"), "quality-sample")  # at most 2 * rows rows
    count = lambda df: {r["_label"]: r["count"] for r in df.groupBy("_label").count().collect()}
    of_all, taken = count(known), count(chosen)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", F.coalesce("_text", F.lit("")).alias("_text"))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [_shares(t) for t in f["_text"]]
            yield pd.DataFrame({"_id": f["_id"], "_label": f["_label"], "rows": [r.astype("<i4").tobytes() for r, _ in made], "shares": [s.astype("<f2").tobytes() for _, s in made]})

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered(("quality", "fit"), int)  # frees another memo
        got = pd.concat([*frames, pd.DataFrame({"_id": [], "_label": [], "rows": [], "shares": []})]).sort_values(["_id", "rows", "shares"], kind="stable")
        y = got["_label"].to_numpy().astype(int)
        held = [(np.frombuffer(r, "<i4"), np.frombuffer(s, "<f2")) for r, s in zip(got["rows"], got["shares"], strict=True)]
        if len(set(y)) < 2:
            yield pd.DataFrame({"logits": [b""], "offset": [float(y.mean() * 8 - 4) if len(y) else 0.0]})
            return
        vectors, weights, offset = train(held, y)
        logits = vectors @ (weights[1] - weights[0])
        yield pd.DataFrame({"logits": [logits.astype("<f4").tobytes()], "offset": [float(offset[1] - offset[0])]})

    # Texts become features where they are; a document's features are 2^18 at most, so the one task holds a bounded sample.
    made = sample.mapInPandas(features, f"_id {dict(sample.dtypes)['_id']}, _label int, rows binary, shares binary")
    row = made.repartition(1).mapInPandas(fitted, "logits binary, offset double").first()
    if not row or not row["logits"]:
        return Model(np.zeros(1 << BITS, np.float32), row["offset"] if row else 0.0)
    rates = [of_all[label] / taken[label] for label in (0, 1)]
    return Model(np.frombuffer(row["logits"], "<f4"), row["offset"] + float(np.log(rates[1] / rates[0])))


class Scorer:
    """A model's sums over the features of the words seen so far."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.codes = Codes()
        self.sum, self.count, self.hash = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.codes) > MEMO_WORDS:
            self.forget()
        codes = [self.codes.of(t.split()) for t in texts]
        sums, counts, hashed = [self.sum], [self.count], [self.hash]
        for new in parts(self.codes.since(len(self.sum))):
            rows, whose, hashes = word_features(new)
            sums.append(np.bincount(whose, weights=self.model.logits[rows], minlength=len(new)))
            counts.append(np.bincount(whose, minlength=len(new)))
            hashed.append(hashes)
        self.sum, self.count, self.hash = np.concatenate(sums), np.concatenate(counts), np.concatenate(hashed)
        z = np.full(len(texts), self.model.offset)
        for i, c in enumerate(codes):
            if len(c):
                total = self.sum[c].sum() + self.model.logits[pair_rows(self.hash[c])].sum(dtype=np.float64)
                z[i] += total / (self.count[c].sum() + len(c) - 1)
        return 1 / (1 + np.exp(-z))


def _scorer(model: Model) -> Scorer:
    return remembered(("quality", model.key), lambda: Scorer(model))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (of class 1) and predicted (1 if score >= threshold, else 0) of each row of docs.

    A text without words, or null, gets the score of the offset alone. Only the two named columns are
    read; repeated rows are scored each by itself, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch, texts in blocks(batches):
            p = scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id").mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def of_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score threshold or more; all columns stay. A null or empty text has the score of the offset alone; repeats go or stay alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch, texts in blocks(batches, text=text_col):
            yield batch.filter(pa.array(scorer.scores(texts) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents; see scored() for nulls and repeats."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
