"""Deterministic random samples, splits and changes of frequency.

A row's place in random order is the md5 of seed and key, so a sample is the same at every run and
partitioning. Exact sizes come from row numbers in that order; quotas are scalars of one-row
aggregates joined to the rows, so each operator stays one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.tables import stored
from .order import numbered


#: Rows of a sample that one task sorts at most.
TAKEN = 100_000


def draw(key: Column | str, seed: int | str) -> Column:
    """The md5 of `seed|key`."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def uniform(key: Column | str, seed: int | str) -> Column:
    """A number of 0 to under 1 from the first 13 hex digits of draw()."""
    return F.conv(F.substring(draw(key, seed), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def choose(pool: list[str], key: Column | str, seed: int | str) -> Column:
    """An element of the pool by draw."""
    at = F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") % len(pool)
    return F.element_at(F.array(*map(F.lit, pool)), (at + 1).cast("int"))


def ranked(df: DataFrame, key: str, seed: int | str, name: str = "_rank") -> DataFrame:
    """df with the row's place from 0 in random order."""
    spot = df.withColumn("_draw", F.conv(F.substring(draw(key, seed), 1, 15), 16, 10).cast("long"))
    return numbered(spot, "_draw", name, (key,)).drop("_draw")


def shuffled(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


def sample(df: DataFrame, n: int, key: str, seed: int | str, short: str = "all") -> DataFrame:
    """n rows without replacement. With too few rows: all of them, or an error for short="error". Up to TAKEN rows come together in one task; more are found by their place in order."""
    if short == "error" and (there := df.limit(n).count()) < n:
        raise ValueError(f"{n} rows wanted, {there} there")
    if n > TAKEN:
        return ranked(df, key, seed, "_place").where(F.col("_place") < n).drop("_place")
    return df.orderBy(draw(key, seed), key).limit(n)


def stratified_halves(df: DataFrame, first: Column, n: int, key: str, seed: int | str) -> DataFrame:
    """n // 2 rows for which first holds, if there are so many, and others up to n."""
    a = sample(df.where(first), n // 2, key, seed)
    size = a.agg(F.count(F.lit(1)).alias("_took"))
    b = sample(df.where(~first), n, key, seed)
    order = Window.orderBy(draw(key, seed), key)  # n rows at most
    b = b.withColumn("_at", F.row_number().over(order)).join(F.broadcast(size)).where(F.col("_at") <= n - F.col("_took")).drop("_at", "_took")
    return a.unionByName(b)


def clusters(df: DataFrame, cluster: str, n: int, seed: int | str, name: str = "new_id") -> DataFrame:
    """All rows of n sampled clusters, numbered anew from 0 in order of the old ids."""
    ids = sample(df.select(cluster).distinct(), n, cluster, seed)
    order = Window.orderBy(cluster)  # n rows at most
    return df.join(ids.withColumn(name, F.dense_rank().over(order) - 1), cluster)


def split_groups(df: DataFrame, group: str, share: float, seed: int | str, name: str = "split") -> DataFrame:
    """Whole groups to train (floor of share of the groups) or eval."""
    ids = ranked(df.select(group).distinct(), group, seed)
    size = ids.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("_cut"))
    parts = ids.join(F.broadcast(size)).select(group, F.when(F.col("_rank") < F.col("_cut"), "train").otherwise("eval").alias(name))
    return df.join(parts, group)


def split_test_final(df: DataFrame, n_test: int, n_final: int, key: str, seed: int | str, name: str = "split") -> DataFrame:
    """n_test random rows as test, the next n_final (or what is left) as final; an error with fewer than n_test rows."""
    if (there := df.limit(n_test).count()) < n_test:
        raise ValueError(f"{n_test} test rows wanted, {there} there")
    rows = ranked(df, key, seed)
    rows = rows.where(F.col("_rank") < n_test + n_final)
    return rows.withColumn(name, F.when(F.col("_rank") < n_test, "test").otherwise("final")).drop("_rank")


def disjoint_picks(df: DataFrame, sizes: dict[str, int], key: str, seed: int | str, name: str = "pick") -> DataFrame:
    """Disjoint random picks of the given sizes out of one random order."""
    total = sum(sizes.values())
    order = Window.orderBy(draw(key, seed), key)  # total rows at most
    rows = sample(df, total, key, seed).withColumn("_at", F.row_number().over(order) - 1)
    label, at = F.lit(None).cast("string"), 0
    for pick, n in sizes.items():
        label = F.when((F.col("_at") >= at) & (F.col("_at") < at + n), F.lit(pick)).otherwise(label)
        at += n
    return rows.withColumn(name, label).drop("_at")


def _trunc(c: Column) -> Column:
    return c.cast("long")


class Parts:
    """Rows of several origins, each ranked once in its own random order and stored, from which datasets of given sizes are cut."""

    def __init__(self, parts: dict[str, DataFrame], key: str, seed: int | str):
        rows = None
        for origin, part in parts.items():
            named = part.withColumn("origin", F.lit(origin))
            rows = named if rows is None else rows.unionByName(named)
        spot = rows.withColumn("_draw", F.conv(F.substring(draw(key, seed), 1, 15), 16, 10).cast("long"))
        self.rows = stored(numbered(spot, "_draw", "_rank", (key,), by="origin").drop("_draw"), "ranked-parts")
        self.sizes = self.rows.agg(*(F.count_if(F.col("origin") == o).alias(f"n_{o}") for o in parts))

    def short(self, wanted: dict[str, Column], *context: Column) -> None:
        """An error if an origin has fewer rows than are wanted of it."""
        for origin, n in wanted.items():
            row = self.sizes.select(n.alias("n"), F.col(f"n_{origin}").alias("there")).where("n > there").first()
            if row:
                raise ValueError(f"{row['n']} {origin} rows wanted, {row['there']} there")

    def cut(self, limits: dict[str, dict[str, Column]]) -> DataFrame:
        """The rows whose rank is under their origin's limit, with dataset: limits by dataset and origin, from columns n_ and the origin's name.

        All datasets are cut in one pass by a join with a row for each dataset and origin.
        """
        wanted = [F.struct(F.lit(d).alias("dataset"), F.lit(o).alias("origin"), n.cast("long").alias("_limit")) for d, part in limits.items() for o, n in part.items()]
        table = self.sizes.select(F.inline(F.array(*wanted)))
        return self.rows.join(F.broadcast(table), "origin").where(F.col("_rank") < F.col("_limit")).drop("_rank", "_limit")


def augment(base: DataFrame, target: DataFrame, fillers: DataFrame, n: int, start: float, goal: float, key: str, seed: int | str) -> DataFrame:
    """base and n more rows, so many of target that its frequency goes from start to goal, the rest fillers.

    Adds `origin`. The number of target rows is round((goal - start) * N + goal * n), half to even, held
    between 0 and what there is. An error if the fillers don't suffice.
    """
    parts = Parts({"base": base, "target": target, "filler": fillers}, key, seed)
    wanted = F.bround((F.lit(goal) - F.lit(start)) * F.col("n_base") + F.lit(goal) * n).cast("long")
    quota = F.greatest(F.lit(0), F.least(wanted, F.col("n_target"), F.lit(n)))
    parts.short({"filler": F.lit(n) - quota})
    return parts.cut({"": {"base": F.col("n_base"), "target": quota, "filler": F.lit(n) - quota}}).drop("dataset")


def replace_exact(base: DataFrame, target: DataFrame, start: float, goal: float, key: str, seed: int | str) -> DataFrame:
    """As many rows as base, int(N (goal - start) / (1 - start)) of them from target instead of random base rows. Adds `origin`."""
    parts = Parts({"base": base, "target": target}, key, seed)
    k = _trunc(F.col("n_base") * (F.lit(goal) - F.lit(start)) / (1 - F.lit(start)))
    parts.short({"target": k})
    return parts.cut({"": {"base": F.col("n_base") - k, "target": k}}).drop("dataset")


def _two(starts: tuple[float, float], goals: tuple[float, float]) -> dict[str, Column]:
    s1, s2 = starts
    t1, t2 = goals
    k1 = _trunc((1 - F.lit(s2)) * F.col("n_base") * F.lit(t1) / (1 - F.lit(s2) - F.lit(s2) * F.lit(s1)))
    k2 = _trunc((1 - F.lit(s1)) * F.col("n_base") * F.lit(t2) / (1 - F.lit(s1) - F.lit(s2) * F.lit(s1)))
    first, second = F.least(k1, F.col("n_first")), F.least(k2, F.col("n_second"))
    return {"base": F.col("n_base") - first - second, "first": first, "second": second}


def replace_two(base: DataFrame, first: DataFrame, second: DataFrame, starts: tuple[float, float], goals: tuple[float, float], key: str, seed: int | str) -> DataFrame:
    """As many rows as base, with random base rows replaced by rows of two structures to reach both goal frequencies. Adds `origin`."""
    return frequency_grid(base, first, second, starts, [goals], key, seed).drop("dataset")


def frequency_grid(base: DataFrame, first: DataFrame, second: DataFrame, starts: tuple[float, float], goals: list[tuple[float, float]], key: str, seed: int | str) -> DataFrame:
    """replace_two() for each pair of goals, in one table with `dataset`, named rc_%04d_q_%04d. Rows are ranked once for all goals."""
    parts = Parts({"base": base, "first": first, "second": second}, key, seed)
    return parts.cut({f"rc_{round(a * 10000):04d}_q_{round(b * 10000):04d}": _two(starts, (a, b)) for a, b in goals})


def rejected_until(make, accept: Column, n: int, key: str, size: int, rounds: int = 20) -> DataFrame:
    """n distinct accepted values of key; make(start, size) gives candidates number start and up.

    Twice as many candidates are made each round until enough are accepted, or an error after the last round, so
    a pool with fewer than n values can't keep it going.
    """
    for _ in range(rounds):
        got = make(0, size).where(accept).groupBy(key).agg(F.min("number").alias("number"))
        if got.limit(n).count() == n:
            return got.orderBy("number").limit(n)
        size *= 2
    raise ValueError(f"fewer than {n} distinct rows in {size // 2} candidates")
