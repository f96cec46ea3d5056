"""What the operators of this subpackage share: shared-folder tables, word numbering, block sizes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import opened  # noqa: F401  (for the tasks that open files of the shared folder)
from ..sources.tables import new_folder, shared_folder, stored  # noqa: F401

#: Bytes of text that a Python worker handles as one block.
BLOCK_CHARS = 8_000_000
#: Distinct words that a worker remembers from block to block.
MEMO_WORDS = 300_000
#: White space of the text contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_stored(spark: SparkSession) -> None:
    """Deletes all tables and archives that this application has stored; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/corpusmill/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many partitions as there are cores at least: a table that the reader cuts into fewer splits is dealt out anew. No row hangs on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, F.xxhash64(key))


#: A key that more than one in so many rows have is hot; there can't be more hot keys than this.
HOT = 1000


def joined_hot(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, left: bool = False) -> DataFrame:
    """rows joined with groups, which has each key once and in size how many of the total rows have it; the size goes. With left, rows without a group stay.

    Hot keys are broadcast, at most HOT rows whatever the input, so that their rows stay where they are; all other keys have under a
    thousandth of the rows and are joined by a shuffle.
    """
    hot = F.col(size) * HOT > total
    extra = [c for c in groups.columns if c not in on and c != size]
    names = {c: f"_hot_{c}" for c in extra}
    few = groups.where(hot).select(*on, F.lit(True).alias("_hot"), *(F.col(c).alias(n) for c, n in names.items()))
    marked = rows.join(F.broadcast(few), on, "left")
    here = marked.where("_hot").select(*rows.columns, *(F.col(n).alias(c) for c, n in names.items()))
    rest = marked.where("_hot is null").select(*rows.columns).join(groups.where(~hot).select(*on, *extra).hint("merge"), on, "left" if left else "inner")
    return here.unionByName(rest.select(*here.columns))


#: Bits of a screen, as a power of two: 16 MB whatever the input.
SCREEN_BITS = 27


def screen(hashes: DataFrame) -> Callable[[F.Column], F.Column]:
    """A test that says no only to hashes (long) that the one column of hashes lacks; it lets most of the others through only if there are too many.

    The bits are set by an aggregation in slices of 4 kB and broadcast. The fuller the screen, the less it saves; it decides nothing.
    """
    spark, bits = hashes.sparkSession, np.zeros(1 << SCREEN_BITS - 3, np.uint8)
    place = lambda h: F.pmod(h, F.lit(1 << SCREEN_BITS)).cast("long")
    at = place(F.col(hashes.columns[0])) + 1
    for number, raw in hashes.groupBy(F.bitmap_bucket_number(at)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at))).collect():
        bits[(number - 1) * 4096 : number * 4096] = np.frombuffer(raw, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(place: pd.Series) -> pd.Series:
        i = place.to_numpy()
        return pd.Series((shared.value[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool))

    return lambda h: held(place(h))


def without(df: DataFrame, gone: DataFrame, keys: dict[str, F.Column]) -> DataFrame:
    """df without the rows whose keys (by column of gone) are in gone. Rows that a screen of gone's keys knows to stay aren't moved."""
    names = {c: f"_gone_{c}" for c in keys}
    gone = stored(gone.select(*(F.col(c).alias(n) for c, n in names.items())).distinct(), "gone")
    maybe = screen(gone.select(F.xxhash64(*names.values())))
    lost = None
    for c, key in keys.items():
        same = key == F.col(names[c])
        lost = same if lost is None else lost & same
    doubt = maybe(F.xxhash64(*keys.values()))
    return df.where(~doubt).unionByName(df.where(doubt).join(gone.hint("merge"), lost, "left_anti"))


#: New words whose features are worked out at a time.
LEARN_WORDS = 1 << 14


class Codes(dict):
    """Numbers words in order of first sight: codes[word]."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def since(self, n: int) -> list:
        """The words numbered n and above, in order."""
        words = list(self)
        return words[n:]


def parts(words: list, size: int = LEARN_WORDS) -> Iterator[list]:
    for at in range(0, len(words), size):
        yield words[at : at + size]


def blocks(batches: Iterator, text: str = "text", size: int = BLOCK_CHARS) -> Iterator[tuple]:
    """Record batches, cut to about size bytes of text: (batch, its texts with null as empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, end - at), [t or "" for t in column.slice(at, end - at).to_pylist()]
            at = end


_T = TypeVar("_T")
_slot: dict = {}


def remembered(key: tuple, make: Callable[[], _T]) -> _T:
    """The Python worker's one memo: what make() gave for the key; another key's memo goes and its memory is given back, so that they don't add up."""
    if key not in _slot:
        if _slot:
            _slot.clear()
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass
        _slot[key] = make()
    return _slot[key]


def by_hash(column: str, seed: str) -> F.Column:
    """A number of 0 to 2^31-1, even over the values of column and alike at every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 31))
