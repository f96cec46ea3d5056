"""The mixed model y ~ filler * gap + (1 | item) on any table: items may lack cells and have several values of a cell.

One aggregation by item gives the numbers and sums of its four cells, one by size of item what the likelihood needs of them: an item's
covariance hangs on its size alone. So a model is fitted on a row for each size of item, at most the square root of twice the number
of values, whatever the number of items; the models of several groups are fitted side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.tables import stored
from .factorial import CELLS, valid
from .order import BROADCAST_ROWS

_PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]
#: What an effect takes of the four cells' means, in order of CELLS, with filler and gap coded -0.5 and 0.5.
EFFECTS = {"0": (0.25, 0.25, 0.25, 0.25), "filler": (0.5, 0.5, -0.5, -0.5), "gap": (0.5, -0.5, 0.5, -0.5), "interaction": (1.0, -1.0, -1.0, 1.0)}
RESULT = [*(f"{what}_{name}" for what in ("b", "se", "z", "p") for name in EFFECTS), "sigma2", "tau2", "licensing", "licensing_low", "licensing_high"]
#: Logarithms of the ratio of variances between which the likelihood is looked over before its best place is narrowed down.
_LOW, _HIGH, _POINTS = -14.0, 14.0, 57


def by_size(rows: DataFrame, item: str = "item", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """For each group and size of item: _items, _centre (the group's mean), the items' cells' numbers n, sums s of y less the centre, their products, and squares.

    rows without a number y, an item, or filler and gap of 0 or 1 don't count.
    """
    # The cells stand in order of CELLS: filler and gap, filler alone, gap alone, none.
    full = rows.where(valid(y) & F.col(item).isNotNull() & F.col("filler").isin(0, 1) & F.col("gap").isin(0, 1))
    full = full.select(*by, F.col(item).alias("_item"), (3 - 2 * F.col("filler") - F.col("gap")).cast("int").alias("_cell"), F.col(y).cast("double").alias("_y"))
    if by:
        centres = full.groupBy(*by).agg(F.avg("_y").alias("_centre")).select(*(F.col(c).alias(f"_by_{c}") for c in by), "_centre")
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        centres = stored(centres, "centres")
        full = full.join(F.broadcast(centres) if centres.count() <= BROADCAST_ROWS else centres, same).drop(*(f"_by_{c}" for c in by))
    else:
        full = full.join(F.broadcast(full.agg(F.avg("_y").alias("_centre"))))  # one row
    full = full.withColumn("_y", F.col("_y") - F.col("_centre"))
    cell = lambda c: F.col("_cell") == c
    sums = [F.count_if(cell(c)).cast("double").alias(f"n{c}") for c in range(4)] + [F.sum(F.when(cell(c), F.col("_y")).otherwise(0.0)).alias(f"s{c}") for c in range(4)]
    # Dealt out by item before they are summed: a task then holds the items of its part, which are fewer the more shuffle partitions there are.
    full = full.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_item")
    items = full.groupBy(*by, "_centre", "_item").agg(*sums, F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    n, s = sum((F.col(f"n{c}") for c in range(1, 4)), F.col("n0")), sum((F.col(f"s{c}") for c in range(1, 4)), F.col("s0"))
    return items.groupBy(*by, "_centre", n.alias("_size")).agg(
        F.count(F.lit(1)).cast("double").alias("_items"), F.sum("yy").alias("yy"), F.sum(s * s).alias("ss"), *(F.sum(f"{x}{c}").alias(f"{x}{c}") for x in "ns" for c in range(4)),
        *(F.sum(F.col(f"n{c}") * s).alias(f"h{c}") for c in range(4)), *(F.sum(F.col(f"n{a}") * F.col(f"n{b}")).alias(f"g{a}{b}") for a, b in _PAIRS),
    )


class Likelihood:
    """The restricted likelihood over the ratio of the items' variance to the residual one."""

    def __init__(self, sizes: pd.DataFrame):
        self.size, self.items = sizes["_size"].to_numpy(), sizes["_items"].to_numpy()
        self.n, self.s = (sizes[[f"{x}{c}" for c in range(4)]].to_numpy().sum(axis=0) for x in "ns")
        self.yy, self.ss = sizes["yy"].sum(), sizes["ss"].to_numpy()
        self.h = sizes[[f"h{c}" for c in range(4)]].to_numpy()
        self.g = np.zeros((len(sizes), 4, 4))
        for a, b in _PAIRS:
            self.g[:, a, b] = self.g[:, b, a] = sizes[f"g{a}{b}"]

    def solved(self, ratio: float) -> tuple[np.ndarray, np.ndarray, float]:
        """The cells' means, the inverse of their precision, and the weighted sum of squares that is left."""
        w = ratio / (1 + ratio * self.size)
        inverse = np.linalg.inv(np.diag(self.n) - np.tensordot(w, self.g, 1))
        right = self.s - w @ self.h
        means = inverse @ right
        return means, inverse, max(self.yy - w @ self.ss - right @ means, 0.0)

    def value(self, ratio: float) -> float:
        """Minus twice the logarithm of the likelihood, but for a constant."""
        _, inverse, left = self.solved(ratio)
        return float((self.n.sum() - 4) * np.log(max(left, 1e-300)) - np.linalg.slogdet(inverse)[1] + self.items @ np.log1p(ratio * self.size))

    def slope(self, ratio: float) -> float:
        """The derivative of value()."""
        means, inverse, left = self.solved(ratio)
        w = 1 / (1 + ratio * self.size) ** 2
        squares = self.ss - 2 * self.h @ means + np.einsum("kab,a,b->k", self.g, means, means)
        return float(-(self.n.sum() - 4) * (w @ squares) / max(left, 1e-300) - np.einsum("ab,ba->", inverse, np.tensordot(w, self.g, 1)) + (self.items * self.size) @ (1 / (1 + ratio * self.size)))

    def best(self) -> float:
        """The ratio of the highest likelihood; 0 if it falls from there on."""
        places = np.linspace(_LOW, _HIGH, _POINTS)
        values = [self.value(np.exp(x)) for x in places]
        at = int(np.argmin(values))
        if self.value(0.0) <= values[at]:
            return 0.0
        low, high = places[max(0, at - 1)], places[min(_POINTS - 1, at + 1)]
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if self.slope(np.exp(mid)) < 0 else (low, mid)
        return float(np.exp((low + high) / 2))


def estimates(sizes: pd.DataFrame) -> dict[str, float]:
    """RESULT of the model of the items whose rows of by_size() these are; NaN where a cell is missing from all items or no value is left over."""
    model = Likelihood(sizes)
    if (model.n == 0).any() or model.n.sum() <= 4:
        return dict.fromkeys(RESULT, float("nan"))
    ratio = model.best()
    means, inverse, left = model.solved(ratio)
    sigma2, out = left / (model.n.sum() - 4), {}
    for name, effect in EFFECTS.items():
        c = np.array(effect)
        b, se = float(c @ means) + (sizes["_centre"].iloc[0] if name == "0" else 0.0), float(np.sqrt(sigma2 * (c @ inverse @ c)))
        z = b / se if se else float("nan")
        out |= {f"b_{name}": b, f"se_{name}": se, f"z_{name}": z, f"p_{name}": stats.normal_two_sided(z)}
    reach = stats.Z975 * out["se_interaction"]
    return out | {"sigma2": sigma2, "tau2": ratio * sigma2, "licensing": -out["b_interaction"], "licensing_low": -out["b_interaction"] - reach, "licensing_high": -out["b_interaction"] + reach}


def fitted(rows: DataFrame, item: str = "item", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group of by (one without it): n_obs, n_items, then by REML the estimates b, their standard errors se, z and p values of the
    intercept (0), filler, gap and interaction, sigma2 and tau2 (the residual and the items' variance), licensing (the negative of the interaction) with its 95 % bounds.

    Every row with a number counts, see by_size(). A table without rows has no model.
    """
    kinds = dict(rows.dtypes)

    def fit(sizes: pd.DataFrame) -> pd.DataFrame:
        row = {c: sizes[c].iloc[0] for c in by} | {"n_obs": int(sizes[[f"n{c}" for c in range(len(CELLS))]].to_numpy().sum()), "n_items": int(sizes["_items"].sum())}
        return pd.DataFrame([row | estimates(sizes)])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n_obs long", "n_items long", *(f"{c} double" for c in RESULT)])
    return by_size(rows, item, y, by).groupBy(*(by or [F.lit(0).alias("_all")])).applyInPandas(fit, schema)
