"""Mixed models against a dense solution, densities against sums over all values."""

from __future__ import annotations

import math

import numpy as np
import pytest

from corpusmill.operators import density, factorial, mixed

ROWS = "item long, filler int, gap int, y double"


def dense(rows):
    """Estimates, standard errors, residual and item variance from the whole covariance matrix."""
    items, n = sorted({r[0] for r in rows}), len(rows)
    x = np.array([[1, f - 0.5, g - 0.5, (f - 0.5) * (g - 0.5)] for _, f, g, _ in rows])
    y, z = np.array([r[3] for r in rows]), np.array([[float(r[0] == i) for i in items] for r in rows])

    def at(log_ratio):
        v = np.eye(n) + np.exp(log_ratio) * z @ z.T
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        b = np.linalg.solve(a, x.T @ w @ y)
        left = (y - x @ b) @ w @ (y - x @ b)
        return (n - 4) * np.log(left) + np.linalg.slogdet(a)[1] + np.linalg.slogdet(v)[1], b, a, left / (n - 4)

    low, high = -14.0, 14.0
    for _ in range(12):
        grid = np.linspace(low, high, 21)
        k = int(np.argmin([at(t)[0] for t in grid]))
        low, high = grid[max(0, k - 1)], grid[min(20, k + 1)]
    _, b, a, s = at((low + high) / 2)
    return b, np.sqrt(np.diag(np.linalg.inv(a)) * s), s, np.exp((low + high) / 2) * s


def unbalanced(seed, spread, most=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(25):
        u = rng.normal() * spread
        rows += [(i, f, g, float(100 + u + f - 2 * g + f * g * 1.5 + rng.normal())) for f in (0, 1) for g in (0, 1) for _ in range(rng.integers(0, most + 1))]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_mixed_model_of_unbalanced_items(spark, seed):
    """Missing cells and repeats; rows without a number, an item or a cell don't count."""
    rows = unbalanced(seed, 1.0 + seed)
    odd = [(1, 0, 1, float("nan")), (None, 1, 1, 3.0), (2, None, 1, 5.0), (2, 1, 7, 5.0), (3, 1, 1, None)]
    got = mixed.fitted(spark.createDataFrame(rows + odd, ROWS).repartition(3)).first()
    b, se, s, tau = dense(rows)
    assert (got.n_obs, got.n_items) == (len(rows), len({r[0] for r in rows}))
    assert [got.b_0, got.b_filler, got.b_gap, got.b_interaction] == pytest.approx(b.tolist(), abs=1e-6)
    assert [got.se_0, got.se_filler, got.se_gap, got.se_interaction] == pytest.approx(se.tolist(), abs=1e-6)
    assert (got.sigma2, got.tau2) == pytest.approx((s, tau), rel=1e-5)
    assert got.licensing == -got.b_interaction and got.licensing_high - got.licensing == pytest.approx(1.959963984540054 * got.se_interaction)
    assert got.p_gap == pytest.approx(math.erfc(abs(got.z_gap) / math.sqrt(2)))


def test_mixed_model_of_balanced_items_is_the_closed_form(spark):
    rng = np.random.default_rng(7)
    for spread in (2.0, 0.0):
        rows = [(i, f, g, float(rng.normal() + spread * (i % 5) + f)) for i in range(20) for f in (0, 1) for g in (0, 1)]
        df = spark.createDataFrame(rows, ROWS)
        a, b = mixed.fitted(df).first(), factorial.mixed_model(df).first()
        assert [a.b_0, a.b_filler, a.b_gap, a.b_interaction, a.se_0, a.se_filler, a.se_gap, a.se_interaction, a.sigma2] == pytest.approx(
            [b.b_0, b.b_filler, b.b_gap, b.b_interaction, b.se_0, b.se_main, b.se_main, b.se_interaction, b.sigma2], abs=1e-9
        )


def test_mixed_models_by_group(spark):
    """Groups are fitted apart, null is a group; one without a cell, or with nothing left over, has no estimates."""
    parts = {"a": unbalanced(5, 1.5), None: unbalanced(6, 2.5), "lacks": [(1, 0, 0, 1.0), (2, 0, 1, 2.0), (3, 1, 0, 3.0)] * 3, "few": [(1, f, g, 1.0) for f in (0, 1) for g in (0, 1)]}
    rows = [(k, *r, 1, 2.0) for k, of in parts.items() for r in of]
    got = {r["grp"]: r for r in mixed.fitted(spark.createDataFrame(rows, f"grp string, {ROWS}, _item int, _centre double"), by=("grp",)).collect()}
    for k in ("a", None):
        b, se, _, _ = dense(parts[k])
        assert [got[k].b_0, got[k].b_interaction, got[k].se_interaction] == pytest.approx([b[0], b[3], se[3]], abs=1e-6)
    assert got["lacks"].b_0 is None and got["few"].sigma2 is None and got["few"].n_obs == 4
    assert mixed.fitted(spark.createDataFrame([], ROWS)).count() == 0


def test_density_is_near_the_exact_one_and_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(3, 1, 400).tolist(), "b": rng.exponential(2, 300).tolist(), None: [1.0, 2.0, 2.0, 9.0]}
    rows = [(k, v) for k, of in values.items() for v in of] + [("a", None), ("a", float("nan")), ("b", float("inf")), ("same", 4.0), ("same", 4.0)]
    got = density.gaussian(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", "g", points=400).toPandas()
    assert set(got["g"].map(str)) == {"a", "b", "None"}
    for key, of in values.items():
        curve = got[got["g"].isna() if key is None else got["g"] == key].sort_values("point")
        x, of = curve["x"].to_numpy(), np.array(of)
        width = of.std(ddof=1) * len(of) ** -0.2
        exact = np.exp(-(((x[:, None] - of) / width) ** 2) / 2).sum(axis=1) / (len(of) * width * math.sqrt(2 * math.pi))
        assert np.abs(curve["density"].to_numpy() - exact).max() < 0.01 * exact.max()
        assert curve["density"].sum() * (x[1] - x[0]) == pytest.approx(1, abs=0.01)


def test_overlap_of_densities(spark):
    rng = np.random.default_rng(3)
    rows = [("a", v) for v in rng.normal(0, 1, 500)] + [("b", v) for v in rng.normal(0, 1, 500)] + [("far", v) for v in rng.normal(60, 1, 500)]
    curves = density.gaussian(spark.createDataFrame([(k, float(v)) for k, v in rows], "g string, v double"), "v", "g", points=800)
    got = {(r.left, r.right): r.overlap for r in density.overlap(curves, "g", [("a", "b"), ("a", "far"), ("a", "a"), ("a", "none")]).collect()}
    assert got["a", "b"] > 0.85 and got["a", "far"] < 1e-6 and got["a", "a"] == pytest.approx(1, abs=0.01) and got["a", "none"] == 0


def test_density_of_nothing(spark):
    assert density.gaussian(spark.createDataFrame([("a", None)], "g string, v double"), "v", "g").count() == 0
    with pytest.raises(ValueError):
        density.gaussian(spark.createDataFrame([("a", 1.0)], "g string, v double"), "v", "g", points=1)


def test_ablation_against_numpy(spark):
    from corpusmill.operators import ablation

    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (rng.normal(size=6) + [3 * (i % 3), 0, 0, 0, 0, 1]).tolist()) for i in range(90)] + [(90, None, [1.0] * 6), (91, 1, None)]
    got = {r.condition: r for r in ablation.scored(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), {"first": [0], "last": [4, 5]}).collect()}
    x, y = np.array([r[2] for r in rows[:90]]), np.array([r[1] for r in rows[:90]])
    centres = np.array([x[y == k].mean(axis=0) for k in range(3)])
    for name, units in (("", []), ("first", [0]), ("last", [4, 5])):
        z = x.copy()
        z[:, units] = 0
        accuracy = (((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == y).mean()
        assert got[name].n == 90 and got[name].accuracy == pytest.approx(accuracy)
        assert got[name].delta_accuracy == pytest.approx(accuracy - got[""].accuracy)
    assert got["first"].delta_accuracy < -0.3


def test_items_are_dealt_out_before_they_are_summed(spark):
    """No task sums the items of a whole split: the one exchange of the values is by item, and the sums come after it."""
    rows = spark.createDataFrame([("a", i % 50, i % 2, i // 2 % 2, float(i)) for i in range(400)], "grp string, item long, filler int, gap int, y double")
    plan = mixed.by_size(rows, by=("grp",))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
