"""Row numbers and prefix sums over a whole table without a window over it.

The table is written once, dealt to ranges of the order key and sorted there; each row gets its place in its range, or the sum before
it there, as the range is written. What lies before a range comes from a table of one row for each range. So what gives
the rows is worked out once, no row is sent twice, and the number of ranges is that of the session's shuffle partitions, whatever
the keys look like. Equal keys are parted by ties, which should make rows distinct where keys repeat a lot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.tables import stored

_IN_PART = (1 << 33) - 1
#: Rows of sizes that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000


@F.pandas_udf(LongType())
def _sum_before(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The sum of the partition's values before each one, in the order of its rows."""
    total = 0
    for part in values:
        v = part.fillna(0).to_numpy().astype(np.int64)
        ends = np.cumsum(v) + total
        yield pd.Series(ends - v)
        total = int(ends[-1]) if len(ends) else total


def _filled(size: int):
    """The number of each row's run in its partition, in the order of its rows: a run ends where the next value would bring its sum over size."""

    @F.pandas_udf(LongType())
    def number(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run, held = -1, 0
        for part in values:
            got = np.empty(len(part), np.int64)
            for i, v in enumerate(part.fillna(0).astype(np.int64).tolist()):
                if run < 0 or held + v > size:
                    run, held = run + 1, 0
                held += v
                got[i] = run
            yield pd.Series(got)

    return number


def _ranged(df: DataFrame, order: list[str], ranges: int | None, run: Column | None, settled: bool) -> DataFrame:
    """df with _part, the number of the row's range, _at, its place there, and _run, worked out over the range's rows in their order."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (df if settled else stored(df, "order-rows")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PART))})
    return stored(rows if run is None else rows.withColumn("_run", run), "order-ranges")


def _with_base(rows: DataFrame, size: Column, here: str, by: str | None, total: str | None) -> DataFrame:
    """rows with _base, to be added to here, and under total the whole size; each value of by apart."""
    apart = [by] if by else []
    sizes = rows.groupBy(*apart, "_part").agg(size.alias("_t"), F.min_by(here, "_at").alias("_first"))
    every = Window.partitionBy(*apart).orderBy("_part")
    before = F.coalesce(F.sum("_t").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    columns = [(before - F.col("_first")).alias("_base")]
    if total:
        columns.append(F.sum("_t").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total))
    table = sizes.select(*apart, "_part", *columns)
    if not by:
        return rows.join(F.broadcast(table), "_part")  # a row for each range
    table = stored(table, "order-sizes")
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, [*apart, "_part"])


def numbered(df: DataFrame, key: str, name: str, ties: tuple[str, ...] = (), ranges: int | None = None, total: str | None = None, by: str | None = None, settled: bool = False) -> DataFrame:
    """df with name, the running number from 0 in order of key, then ties; under total the number of rows.

    With by, the rows of each of its values are numbered apart; a frequent value still lies in several ranges. settled says that df is a stored table, an aggregate or as cheap
    to work out: it is then read twice, to find the ranges and to deal its rows to them, instead of being written first.
    """
    rows = _ranged(df, [*([by] if by else []), key, *ties], ranges, None, settled)
    rows = _with_base(rows, F.count(F.lit(1)), "_at", by, total)
    return rows.withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def running_sum(
    df: DataFrame, key: str, value: str, name: str, ties: tuple[str, ...] = (), ranges: int | None = None, total: str | None = None, by: str | None = None, settled: bool = False
) -> DataFrame:
    """df with name, the sum of value (integers) over all rows before the row in order of key, then ties; under total the whole sum. by and settled as in numbered()."""
    rows = _ranged(df, [*([by] if by else []), key, *ties], ranges, _sum_before(F.col(value).cast("long")), settled)
    rows = _with_base(rows, F.sum(value), "_run", by, total)
    return rows.withColumn(name, F.col("_base") + F.col("_run")).drop("_part", "_at", "_run", "_base")


def filled(df: DataFrame, key: str, value: str, size: int, run: str, name: str, settled: bool = False) -> DataFrame:
    """df with name, the running number from 0 in order of key, and run, the number from 0 of its run: runs of rows in that order whose values (integers) sum up to size at most, or that have
    one row.

    Each range is filled by itself, so the last run of each of the ranges may be short. settled as in numbered().
    """
    rows = _ranged(df, [key], None, _filled(size)(F.col(value).cast("long")), settled)
    rows = _with_base(rows, F.count(F.lit(1)), "_at", None, None).withColumn(name, F.col("_base") + F.col("_at")).drop("_base")
    rows = _with_base(rows, F.max("_run") + 1, "_run", None, None).withColumn(run, F.col("_base") + F.col("_run"))
    return rows.drop("_part", "_at", "_run", "_base")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: str) -> DataFrame:
    """by and, under each name of shares, the quantile of value of that share, between neighbours in proportion; nulls don't count.

    Equal values are counted first; the running sum of the counts finds the two values around each quantile, so that no group's values
    come together anywhere.
    """
    return quantiles_of_counts(rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), shares, by)


def quantiles_of_counts(counts: DataFrame, shares: dict[str, float], by: str) -> DataFrame:
    """quantiles() from a row for each by and value, _v, that says how often it stands there, _n."""
    placed = running_sum(counts, "_v", "_n", "_before", total="_all", by=by, settled=True)
    at = {name: F.lit(float(share)) * (F.col("_all") - 1) for name, share in shares.items()}
    holds = lambda place: (place >= F.col("_before")) & (place < F.col("_before") + F.col("_n"))
    sides = {}
    for name, place in at.items():
        sides[f"_{name}_low"] = F.max(F.when(holds(F.floor(place)), F.col("_v")))
        sides[f"_{name}_high"] = F.max(F.when(holds(F.ceil(place)), F.col("_v")))
    found = placed.groupBy(by).agg(F.first("_all").alias("_all"), *(c.alias(n) for n, c in sides.items()))
    part = lambda name: at[name] - F.floor(at[name])
    return found.select(by, *((F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * part(n)).alias(n) for n in shares))
