"""SimHash near-duplicates by fuzzy Golay keys.

A 64-bit fingerprint is cut into three segments, and each is decoded to the Golay code words near it (golay.py). Of two
fingerprints that differ in at most four bits, either some segment is equal and another differs in at most two
bits, or all three differ, two of them in one bit and the third in at most two. So a fingerprint gets these keys:

* for each ordered two segments, the one as it is and a near code word of the other (33 bits or more);
* triples of near code words, one of each segment (36 bits). Words that differ in one bit have each the nearest code word of the
  other among its own, so triples without any nearest word can be left out: 70 of 151 are kept on average.

Fingerprints that meet are compared. Equal fingerprints are merged beforehand, so only different ones meet. A
key that more than CAP fingerprints share isn't compared pair by pair: its fingerprints go another exact
way, in which each lists all words within two bits of it (hot_links()). Fingerprints with such a word in
common differ in at most four bits, and any two that do have one in common, so each word links
its fingerprints to the smallest of them. No more than 2,081 fingerprints can share a word. Keys of 33 bits and more reach the cap
where thousands of different fingerprints are near each other, not by the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import blocks, joined_hot, spread, stored, table, without
from .components import components

WORDS = 4
SEED = 42
BITS = 4
#: Where the three segments start, and the end.
CUTS = (0, 21, 42, 64)
#: Most fingerprints of a key that are compared pair by pair.
CAP = 2048
#: Fingerprints whose keys are made at a time, shingles that are counted at a time.
_MANY, _PART = 1 << 13, 1 << 16
_ORDERED = list(permutations(range(3), 2))
#: Which of each segment's keys make a triple: at least one is the nearest code word.
_TRIPLES = [t for t in product(range(golay.KEYS), repeat=3) if 0 in t]


def shingle_hashes(text: str, k: int = WORDS) -> np.ndarray:
    """The XXH64 of each shingle, repeats included: of the whole word sequence if it has fewer words, none for a text without words."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - k].tolist(), ends[k - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        h = hashes[at : at + _PART].astype("<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, k: int = WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    return majority(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (of the text, null as empty) and fp, the fingerprint as a signed long, of each row of docs."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            fp = np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(docs[text_col]).alias("text_hash"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id").mapInArrow(hashed, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, fp long")


def text_hash(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, as (key, index of fingerprint)."""
    u = fps.view(np.uint64)
    parts = [(u >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in zip(CUTS, CUTS[1:], strict=False)]
    near = [golay.keys(p).astype(np.int64) for p in parts]
    keys, owner, me = [], [], np.arange(len(u))
    for tag, (i, j) in enumerate(_ORDERED):
        for b in range(golay.KEYS):
            ok = np.flatnonzero(near[j][:, b] >= 0)
            keys.append((tag << 40) | (parts[i][ok] << 12) | near[j][ok, b])
            owner.append(me[ok])
    for a, b, c in _TRIPLES:
        ok = np.flatnonzero((near[0][:, a] >= 0) & (near[1][:, b] >= 0) & (near[2][:, c] >= 0))
        keys.append((len(_ORDERED) << 40) | (near[0][ok, a] << 24) | (near[1][ok, b] << 12) | near[2][ok, c])
        owner.append(me[ok])
    return np.concatenate(keys), np.concatenate(owner)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    names = ("u", "v", "hot") if len(columns) == 3 else ("key", "fp", "mark")
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(names[: len(columns)]))


def keyed(distinct: DataFrame, cap: int = CAP) -> DataFrame:
    """The keys of distinct fingerprints: key, fp, mark.

    Where a block of fingerprints has a key over cap times, those fingerprints are marked at once:
    cap rows of the key go on at most, the first with mark 1, and the fingerprints of the others come
    with negative keys of their own. So a key shared by a large part of all fingerprints is cut before it is dealt out.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), _MANY):
                part = fps[at : at + _MANY]
                keys, owner = fuzzy_keys(part)
                mark = np.zeros(len(keys), np.int8)
                order = np.argsort(keys, kind="stable")
                starts, lengths = _runs(keys[order])
                for s, n in zip(starts[lengths > cap].tolist(), lengths[lengths > cap].tolist(), strict=True):
                    mark[order[s]] = 1
                    keys[order[s + cap : s + n]] = -1
                if (extra := np.flatnonzero(keys == -1)).size:
                    hot = np.unique(owner[extra])
                    yield _rows(-1 - (part[hot] & 0x7FFFFFFF), part[hot], np.ones(len(hot), np.int8))
                    left = np.flatnonzero(keys != -1)
                    keys, owner, mark = keys[left], owner[left], mark[left]
                yield _rows(keys, part[owner], mark)

    return distinct.select("fp").mapInArrow(make, "key long, fp long, mark tinyint")


def _links(fps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of fingerprints, each linked one with the smallest row it is linked to inside its run."""
    run = np.repeat(np.arange(len(starts)), lengths)
    u = fps.view(np.uint64)
    left, right = [], []
    step, at = 1, np.arange(len(fps))
    while len(at):
        at = at[at + step < len(fps)]
        at = at[run[at] == run[at + step]]
        near = at[np.bitwise_count(u[at] ^ u[at + step]) <= bits]
        left.append(near)
        right.append(near + step)
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    label = np.arange(len(fps))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def met(keys: DataFrame, bits: int = BITS, cap: int = CAP) -> DataFrame:
    """Links among the fingerprints of each key as (u, v), and (u, u, hot) for those of a key of over cap."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, held_m = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        hot_key = None

        def close(k: np.ndarray, f: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts, lengths = _runs(k)
            marked = np.bitwise_or.reduceat(m, starts) > 0 if len(starts) else np.zeros(0, bool)
            hot = (lengths > cap) | marked
            if hot.any():
                yield hot_rows(f[np.repeat(hot, lengths)])
            fine = np.repeat(~hot & (lengths > 1), lengths)
            if fine.any():
                fs = f[fine]
                s, n = _runs(k[fine])
                u, v = _links(fs, s, n, bits)
                if len(u):
                    both = np.unique(np.stack([u, v]), axis=1)
                    yield _rows(both[0], both[1], np.zeros(both.shape[1], bool))

        def hot_rows(f: np.ndarray) -> pa.RecordBatch:
            f = np.unique(f)
            return _rows(f, f, np.ones(len(f), bool))

        for batch in batches:
            k, f, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if own := int(np.searchsorted(k, 0)):
                yield hot_rows(f[:own])
                k, f, m = k[own:], f[own:], m[own:]
            if not len(k):
                continue
            if hot_key is not None:
                n = int(np.searchsorted(k, hot_key, side="right")) if k[0] <= hot_key else 0
                if n:
                    yield hot_rows(f[:n])
                    k, f, m = k[n:], f[n:], m[n:]
                if not len(k):
                    continue
                hot_key = None
            k, f, m = np.concatenate([held_k, k]), np.concatenate([held_f, f]), np.concatenate([held_m, m])
            cut = int(np.searchsorted(k, k[-1], side="left"))
            yield from close(k[:cut], f[:cut], m[:cut])
            held_k, held_f, held_m = k[cut:], f[cut:], m[cut:]
            if len(held_k) > cap or held_m.any():
                yield hot_rows(held_f)
                hot_key, held_k, held_f, held_m = int(held_k[-1]), held_k[:0], held_f[:0], held_m[:0]
        yield from close(held_k, held_f, held_m)

    dealt = keys.repartition("key").sortWithinPartitions("key", F.desc("mark"))
    return dealt.mapInArrow(meet, "u long, v long, hot boolean")


@cache
def _masks(bits: int) -> np.ndarray:
    """All words of at most bits ones."""
    got = [0] + [sum(1 << b for b in c) for w in range(1, bits + 1) for c in combinations(range(64), w)]
    return np.array(got, np.uint64)


def hot_links(hot: DataFrame, bits: int = BITS) -> DataFrame:
    """Links among the distinct fingerprints of hot (fp) that give the same components as all pairs within bits bits: u, v.

    Of two fingerprints that differ in d bits, some word is within (d + 1) // 2 of the one and d // 2 of the other. Of those that share
    a word, each is linked to the smallest of the nearer ones, if there is any; for an even number both are alike.
    """
    far, near = (bits + 1) // 2, bits // 2

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(far)
        out = np.bitwise_count(masks).astype(np.int8) > near
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 64):
                part = fps[at : at + 64]
                words = (part.view(np.uint64)[:, None] ^ masks).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.tile(out, len(part))), pa.array(np.repeat(part, len(masks)))], ["word", "far", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = first = None  # of the last run: its word, and the fingerprint to link to or None
        for batch in batches:
            w, out, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(w):
                continue
            starts, lengths = _runs(w)
            heads, led = f[starts].copy(), ~out[starts].astype(bool)
            if word is not None and w[0] == word:
                heads[0], led[0] = (first, True) if first is not None else (heads[0], False)
            v, ok = np.repeat(heads, lengths), np.repeat(led, lengths)
            word, first = w[-1], heads[-1] if led[-1] else None
            if (other := ok & (f != v)).any():
                both = np.unique(np.stack([f[other], v[other]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    words = hot.select("fp").mapInArrow(around, "word long, far boolean, fp long")
    return words.repartition("word").sortWithinPartitions("word", "far", "fp").mapInArrow(linked, "u long, v long")


def linked_fingerprints(distinct: DataFrame, bits: int = BITS, cap: int = CAP) -> DataFrame:
    """Edges between different fingerprints (fp) that give the same components as all pairs within bits bits, 1 to 4."""
    if not 1 <= bits <= BITS:
        raise ValueError(f"the keys find fingerprints within 1 to {BITS} bits, not {bits}")
    found = stored(met(keyed(distinct, cap), bits, cap), "simhash-met")
    hot = found.where("hot").select(F.col("u").alias("fp")).distinct()
    return found.where("not hot").select("u", "v").unionByName(hot_links(hot, bits))


def _grouped(docs: DataFrame, k: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, fp and component_id of each row of docs."""
    rows = stored(fingerprints(docs, k, id_col, text_col), "simhash-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    n_fps, n_rows = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(linked_fingerprints(distinct, bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "simhash-rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_root")), "simhash-least")
    named = stored(joined_hot(rooted, least, ["root"], "n_root", n_fps).select("fp", "n", "component_id"), "simhash-named")
    return joined_hot(rows, named, ["fp"], "n", n_rows)


def near_groups(docs: DataFrame, k: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links, fingerprints that differ in at most
    bits bits (1 to 4; an error otherwise). Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id
    are rows of their own, each with its text's component; a null doc_id is passed on and names no
    component. Columns other than the two named ones are not read. An empty table gives no rows.
    """
    rows = _grouped(docs, k, bits, id_col, text_col)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, k: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near_groups(), that of the smallest doc_id; all columns stay.

    A row goes by doc_id and text together, so other texts under its doc_id stay unless they go themselves; rows that repeat the smallest
    doc_id within a group stay together. Rows without a doc_id stay. An empty table gives no rows.
    """
    gone = _grouped(docs, k, bits, id_col, text_col).where("doc_id <> component_id")
    return without(docs, gone, {"doc_id": docs[id_col], "text_hash": text_hash(docs[text_col])})


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of every whole text of documents within four bits; see near_groups() for nulls and repeats."""
    return near_groups(table(spark, sf_dir, "documents"))
