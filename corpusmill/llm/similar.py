"""Near copies by Jaccard similarity of their shingles: SimHash and min-hash bands propose pairs, the shingles decide.

A text is the set of its 5-word shingles. Pairs are proposed by

* their SimHash fingerprints of the same shingles, linked within four bits by fuzzy Golay keys (simhash.py). This finds tight copies; of
  copies near the least similarity, whose fingerprints differ in ten bits and more, it finds few;
* min-hash bands: two texts of similarity s share a band's key with probability s^ROWS, and one of the BANDS with
  1 - (1 - s^ROWS)^BANDS: at 0.8 all but 3 pairs of a million meet.

The sets are compared in two rounds, so that a large group of copies isn't compared
pair by pair: first each set with the smallest one that it shares a key with, then those of a key that the
first round left in different components, inside the tasks that have the key's sets, in chunks of bounded size: pairs whose min-hash
sketches are similar are held to their shingles, and only links come out. A pair that isn't compared is in one component already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, joined_hot, screen, spread, stored, without
from .components import components
from .simhash import linked_fingerprints, majority, shingle_hashes, text_hash

WORDS = 5
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
SEED = 42
#: Least share of equal values of two sketches: 0.15 or five deviations below the least similarity.
SKETCH = 0.65
#: Sets of a key that are compared in one go, pairs of a set that are verified in one go.
CHUNK, SALT = 1024, 256
#: Shingles that are min-hashed at a time.
_PART = 1 << 12
_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_MIX = np.uint32(0x85EBCA6B)


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """The hashes of the distinct shingles, in order; none for a text without words."""
    return np.unique(shingle_hashes(text, k))


def set_id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def sketch(found: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the BANDS * ROWS hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _PART):
        h = (short[at : at + _PART, None] ^ _XOR) * _TIMES
        h ^= h >> np.uint32(15)
        h *= _MIX
        np.minimum(least, h.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of a sketch."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, node (the set's id), n (its size), fp (fingerprint) and keys of each row of docs that has an id."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            node, fp, n, keys = [], [], [], []
            for text in texts:
                every = shingle_hashes(text, WORDS)
                found = np.unique(every)
                node.append(set_id(found))
                fp.append(majority(every))
                n.append(len(found))
                keys.append(band_keys(sketch(found)).view(np.int64))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), long(node), pa.array(n, pa.int32()), long(fp), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "node", "n", "fp", "keys"],
            )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id").mapInArrow(sign, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, node long, n int, fp long, keys array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles and sketch of the rows whose doc_id and text_hash are in ids; a screen keeps most other texts from being moved."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            sets = [shingles(t) for t in texts]
            node = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            drawn = pa.array([sketch(s).astype("<u4").tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), drawn], ["node", "shingles", "sketch"])

    maybe = screen(ids.select(F.xxhash64("doc_id", "text_hash")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    chosen = rows.where(maybe(F.xxhash64("doc_id", "text_hash"))).join(ids.hint("merge"), ["doc_id", "text_hash"], "left_semi").select("text")
    return chosen.mapInArrow(make, "node long, shingles array<long>, sketch binary").dropDuplicates(["node"])


def _sets(nodes: DataFrame, asked: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles and sketch of the nodes in asked."""
    ids = stored(nodes.join(asked.hint("merge"), "node", "left_semi").select("example.*"), "similar-asked")
    return stored(sets_of(docs, ids, id_col, text_col), "similar-sets")


def _fits(a: str, b: str) -> F.Column:
    """Sizes of which sets can be similar enough at all."""
    return F.least(a, b).cast("long") * LEAST[1] >= F.greatest(a, b).cast("long") * LEAST[0]


def met(nodes: DataFrame, total: int) -> DataFrame:
    """key, node, n and lead, the smallest set (node, n) of the key, of each set and key that another set has too; total is the number of sets."""
    buckets = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return stored(joined_hot(buckets, stored(shared, "similar-keys"), ["key"], "size", total * BANDS), "similar-met")


def first_pairs(rows: DataFrame) -> DataFrame:
    """u, v: each set with the smallest of the sets that are the smallest of one of its keys."""
    led = rows.where((F.col("node") != F.col("lead.node")) & _fits("n", "lead.n"))
    return led.groupBy(F.col("node").alias("v")).agg(F.min("lead.node").alias("u")).select("u", "v")


def print_pairs(nodes: DataFrame, total: int) -> DataFrame:
    """u, v: sets whose fingerprints simhash.py links, and each set with the smallest one of its fingerprint."""
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")), "similar-prints")
    edges = linked_fingerprints(prints.select("fp"))
    ends = [prints.select(F.col("fp").alias(c), F.col("lead").alias(f"node_{c}")) for c in ("u", "v")]
    linked = edges.join(ends[0].hint("merge"), "u").join(ends[1].hint("merge"), "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    alike = joined_hot(nodes.select("fp", "node"), prints.where("size > 1"), ["fp"], "size", total).where("node <> lead")
    return linked.unionByName(alike.select(F.col("lead").alias("u"), F.col("node").alias("v")))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have the least similarity."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same * LEAST[1] >= (len(a) + len(b) - same) * LEAST[0]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links u, v among the rows (grp, chunk, cross, node, root, sketch, shingles), sorted by group, that have different roots; across chunks if cross.

    Rows that a link has put together aren't compared any more.
    """
    held: list = []

    def close(grp, chunk, cross, node, root, drawn, sets) -> Iterator[pa.RecordBatch]:
        n, at, step, label, out = len(grp), np.arange(len(grp)), 1, root.copy(), []
        size = np.fromiter((len(x) for x in sets), np.int64, n)
        while len(at):
            at = at[at + step < n]
            at = at[grp[at] == grp[at + step]]
            to = at + step
            fits = np.minimum(size[at], size[to]) * LEAST[1] >= np.maximum(size[at], size[to]) * LEAST[0]
            asked = at[fits & (label[at] != label[to]) & (~cross[at] | (chunk[at] != chunk[to]))]
            for part in np.array_split(asked, max(1, -(-len(asked) // 4096))):
                for i in part[(drawn[part] == drawn[part + step]).mean(axis=1) >= SKETCH].tolist():
                    j = i + step
                    if label[i] != label[j] and alike(sets[i], sets[j]):
                        first, last = np.searchsorted(grp, grp[i]), np.searchsorted(grp, grp[i], side="right")
                        here = label[first:last]
                        here[here == label[j]] = label[i]
                        out.append((node[i], node[j]))
            step += 1
        if out:
            u, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u4").reshape(-1, BANDS * ROWS))
        column = batch.column(6)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(column.offsets.to_numpy()))
        sets = np.split(flat, ends[:-1])
        held = [np.concatenate([a, b]) for a, b in zip(held[:6], now, strict=True)] + [held[6] + sets] if held else [*now, sets]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield from close(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held:
        yield from close(*held)


def other_links(rows: DataFrame, roots: DataFrame, drawn: Callable[[DataFrame], DataFrame], total: int) -> DataFrame:
    """u, v: links among the sets of each key that have different roots as yet (drawn gives node, sketch and shingles of a table of nodes); the same components as all of them."""
    rooted = rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted.select("key", "node", "root"), "similar-rooted-keys")
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    keys = stored(keys.select("key", "size", F.ceil(F.col("size") / CHUNK).alias("chunks")), "similar-mixed-keys")
    mixed = stored(joined_hot(rooted, keys, ["key"], "size", total * BANDS).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))), "similar-mixed")
    each = mixed.select("key", "node", "root", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    each = each.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("grp"), "chunk", (F.col("chunk") != F.col("other")).alias("cross"), "node", "root")
    full = each.join(drawn(mixed.select("node").distinct()).hint("merge"), "node").select("grp", "chunk", "cross", "node", "root", "sketch", "shingles")
    return full.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(_links, "u long, v long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) whose shingles are similar enough. A set with many pairs goes to several places, so that none gets all of them."""
    counts = stored(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("size")).withColumn("copies", F.ceil(F.col("size") / SALT)), "similar-counts")
    total = counts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sets = _sets(nodes, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs, id_col, text_col)
    salted = joined_hot(pairs, counts, ["u"], "size", total).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("copies")))
    right = salted.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")).hint("merge"), "v")
    spread_u = counts.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    left = spread_u.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")).hint("merge"), "u")
    both = right.join(left.hint("merge"), ["u", "salt"])
    same = F.size(F.array_intersect("a", "b")).cast("long")
    return both.where(same * LEAST[1] >= (F.size("a") + F.size("b") - same) * LEAST[0]).select("u", "v")


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id; all columns stay.

    Groups are the components over pairs of similarity 0.8 or more; texts of equal shingles are one. Null and empty texts have
    no shingles and are alike. A row goes by doc_id and text together, so other rows of its doc_id stay; rows that repeat the smallest
    doc_id in a group stay together. Rows without an id stay and link nothing. An empty table gives no rows.
    """
    rows = stored(signed(docs, id_col, text_col), "similar-rows")
    example = F.min(F.struct("doc_id", "text_hash"))
    nodes = rows.groupBy("node").agg(example.alias("example"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.count(F.lit(1)).alias("size"))
    nodes = stored(nodes, "similar-nodes")
    total, n_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    keyed = met(nodes, total)
    first = stored(first_pairs(keyed).unionByName(print_pairs(nodes, total)).distinct(), "similar-first")
    links = stored(verified(first, nodes, docs, id_col, text_col), "similar-links")
    other = stored(other_links(keyed, components(links), lambda asked: _sets(nodes, asked, docs, id_col, text_col), total), "similar-other")
    roots = components(links.unionByName(other))
    rooted = nodes.select("node", "size", F.col("example.doc_id").alias("least")).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "similar-rooted")
    kept = stored(rooted.groupBy("root").agg(F.min("least").alias("kept"), F.count(F.lit(1)).alias("n_root")), "similar-kept")
    named = stored(joined_hot(rooted, kept, ["root"], "n_root", total).select("node", "size", "kept"), "similar-named")
    gone = joined_hot(rows.select("doc_id", "text_hash", "node"), named, ["node"], "size", n_rows).where("doc_id <> kept")
    return without(docs, gone, {"doc_id": docs[id_col], "text_hash": text_hash(docs[text_col])})
