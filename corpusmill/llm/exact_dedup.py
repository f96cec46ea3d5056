"""Exact deduplication against immutable snapshots that binary-fuse filters screen.

Each batch of documents becomes one immutable snapshot: its distinct digests, dealt to buckets,
with a static binary-fuse filter for each bucket. Digests of a batch are screened by the
filters of the snapshots before it; those that pass join the exact buckets, and the texts behind
each match are compared byte by byte. Copies inside a batch are grouped by themselves.

Digests are shuffled. Texts move for digests that two snapshots share, one text of each; a screen of fixed size keeps
most other texts where they are. Digests that a thousandth of the rows or more have are joined by broadcast, so that a hot one doesn't land in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .common import SPACES, joined_hot, screen, stored, table, without

#: Digests in a bucket of a snapshot, about.
BUCKET_KEYS = 1 << 15
#: Into so many batches the query divides its table.
BATCHES = 3


def normalised(text: str | F.Column) -> F.Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: F.Column | None = None) -> DataFrame:
    """A narrow row for each document: doc_id, digest, batch."""
    batch = F.pmod(F.xxhash64(F.col(id_col)), F.lit(BATCHES)).cast("int") if batch is None else batch
    return docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"), batch.alias("batch")
    )


def snapshots(groups: DataFrame) -> DataFrame:
    """The filters: a row (batch, bucket, filter) for each bucket of each snapshot."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch": [pdf.batch.iloc[0]], "bucket": [pdf.bucket.iloc[0]], "filter": [fuse.build(pdf.key.to_numpy())]})

    return groups.select("batch", "bucket", "key").groupBy("batch", "bucket").applyInPandas(build, "batch int, bucket long, filter binary")


def screened(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests that an earlier snapshot's filter lets through: digest, batch, snapshot."""

    def screen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, batch, out = left.key.to_numpy(), left.batch.to_numpy(), []
        for snapshot, blob in zip(right.batch, right["filter"], strict=True):
            later = np.flatnonzero(batch > snapshot)
            hit = later[fuse.contains(blob, keys[later])]
            out.append(pd.DataFrame({"digest": left.digest.to_numpy()[hit], "batch": batch[hit], "snapshot": np.int32(snapshot)}))
        return pd.concat(out) if out else pd.DataFrame({"digest": [], "batch": [], "snapshot": []})

    left = groups.select("bucket", "digest", "key", "batch").groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(screen, "digest binary, batch int, snapshot int")


def groups_of(rows: DataFrame) -> DataFrame:
    """The distinct digests of each batch: batch, digest, keep_id, group_size, key, bucket."""
    groups = rows.groupBy("batch", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.withColumn("key", F.xxhash64("digest")), "dedup-groups")
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))
    return groups.withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(buckets)))


def checked(docs: DataFrame, matches: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those digests of matches (digest, one doc_id of each snapshot) whose texts are the same bytes.

    Only texts whose doc_id a screen of the wanted ones lets through are dealt out.
    """
    wanted = stored(matches.select("digest", "doc_id").distinct(), "dedup-wanted")
    maybe = screen(wanted.select(F.xxhash64("doc_id")))
    mine = wanted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(maybe(F.xxhash64("_id"))).join(mine.hint("merge"), "_id")
    texts = texts.select("_digest", normalised("_text").alias("_text"))
    texts = texts.where(F.unhex(F.sha2("_text", 256)) == F.col("_digest"))
    same = texts.groupBy("_digest").agg(F.min("_text").alias("a"), F.max("_text").alias("b"))
    return same.where(F.col("a") == F.col("b")).select(F.col("_digest").alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. A row stays if its doc_id is the smallest of its group, so rows that
    repeat one doc_id with one text stay or go together. Rows without a doc_id count in group_size
    and stay only if no row of the group has one; keep_id is null then. Columns other than the two
    named ones are not read. An empty table gives no rows.
    """
    rows = stored(digests(docs, id_col, text_col), "dedup-digests")
    groups = groups_of(rows)
    filters = stored(snapshots(groups), "dedup-filters")
    passed = screened(groups, filters)
    exact = groups.select("digest", F.col("batch").alias("snapshot"), F.col("keep_id").alias("there"))
    mine = groups.select("digest", "batch", "keep_id")
    pairs = stored(passed.join(exact, ["digest", "snapshot"]).join(mine, ["digest", "batch"]), "dedup-pairs")
    either = pairs.select("digest", F.explode(F.array("there", "keep_id")).alias("doc_id"))
    linked = checked(docs, either.where("doc_id is not null"), id_col, text_col).withColumn("linked", F.lit(True))
    unnamed = pairs.where("there is null or keep_id is null").select("digest").distinct().withColumn("unnamed", F.lit(True))
    known = groups.join(linked, "digest", "left").join(unnamed, "digest", "left")
    known = known.withColumn("part", F.when(F.col("linked") | F.col("unnamed"), F.lit(-1)).otherwise(F.col("batch")))
    whole = known.groupBy("digest", "part").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.collect_set("batch").alias("batches"))
    whole = whole.select("digest", F.explode("batches").alias("batch"), "keep_id", "group_size")
    sizes = groups.select("digest", "batch", F.col("group_size").alias("n_here"))
    whole = stored(whole.join(sizes.hint("merge"), ["digest", "batch"]), "dedup-whole")
    total = whole.agg(F.coalesce(F.sum("n_here"), F.lit(0))).first()[0]
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined_hot(rows, whole, ["digest", "batch"], "n_here", total).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops; all columns stay.

    A row goes by doc_id and text together. Rows without a doc_id go if a row of their text has one. An empty table gives no rows.
    """
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.unhex("text_sha256").alias("digest"))
    return without(docs, gone, {"id": F.coalesce(docs[id_col].cast("string"), F.lit("")), "digest": F.unhex(F.sha2(normalised(docs[text_col]), 256))})


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over the whole of documents; see exact_dedup() for nulls and repeats."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
