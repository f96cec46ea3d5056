"""Models and densities over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ablation, density, evaluate, mixed, sampling
from ..sources.tables import stored
from .base import table
from .catalog import query

_FOUR = range(4)
_PAIRS = [(a, b) for a in _FOUR for b in range(a, 4)]


def _sums(weight: str, name: str) -> str:
    """What a weight over the sizes of items makes of their products with the values, and of the products of their cells' numbers."""
    return ", ".join([f"sum({weight} * ss) AS {name}q", *(f"sum({weight} * h{c}) AS {name}h{c}" for c in _FOUR), *(f"sum({weight} * g{a}{b}) AS {name}g{a}{b}" for a, b in _PAIRS)])


def _solved(points: str) -> str:
    """SQL that solves the model at each point, the logarithm of the ratio of variances: the cells' means m, the rest of the squares, the inverse by rows r and d, value and slope."""
    a = {(i, j): f"({f't{i} - ' if i == j else '- '}wg{i}{j})" for i, j in _PAIRS}
    rows = {0: ["1"], 1: ["(-l10)", "1"], 2: ["(l21 * l10 - l20)", "(-l21)", "1"], 3: ["(l31 * l10 + l32 * l20 - l32 * l21 * l10 - l30)", "(l32 * l21 - l31)", "(-l32)", "1"]}
    g = lambda i, j: f"vg{min(i, j)}{max(i, j)}"
    trace = " + ".join(f"({' + '.join(f'{x} * {y} * {g(i, j)}' for i, x in enumerate(r) for j, y in enumerate(r))}) / d{k}" for k, r in rows.items())
    squares = "vq - 2 * (" + " + ".join(f"vh{c} * m{c}" for c in _FOUR) + ") + " + " + ".join(f"{1 if i == j else 2} * vg{i}{j} * m{i} * m{j}" for i, j in _PAIRS)
    steps = [
        f"{a[0, 0]} AS d0", *(f"{a[0, i]} / d0 AS l{i}0" for i in (1, 2, 3)), f"{a[1, 1]} - l10 * {a[0, 1]} AS d1", f"{a[1, 2]} - l10 * {a[0, 2]} AS u12", f"{a[1, 3]} - l10 * {a[0, 3]} AS u13",
        "u12 / d1 AS l21", "u13 / d1 AS l31", f"{a[2, 2]} - l20 * {a[0, 2]} - l21 * u12 AS d2", f"{a[2, 3]} - l20 * {a[0, 3]} - l21 * u13 AS u23", "u23 / d2 AS l32",
        f"{a[3, 3]} - l30 * {a[0, 3]} - l31 * u13 - l32 * u23 AS d3",
        *(f"{' + '.join(f'{x} * (y{i} - wh{i})' for i, x in enumerate(r))} AS z{k}" for k, r in rows.items()),
        "z3 / d3 AS m3", "z2 / d2 - l32 * m3 AS m2", "z1 / d1 - l21 * m2 - l31 * m3 AS m1", "z0 / d0 - l10 * m1 - l20 * m2 - l30 * m3 AS m0",
        "yy - wq - z0 * z0 / d0 - z1 * z1 / d1 - z2 * z2 / d2 - z3 * z3 / d3 AS rest", "(n - 4) * ln(rest) + ln(d0 * d1 * d2 * d3) + ld AS value",
        f"dl - (n - 4) * ({squares}) / rest - ({trace}) AS slope",
    ]
    weighed = f"""SELECT grp, x, any_value(centre) AS centre, sum(items)::BIGINT AS n_items, sum(n0 + n1 + n2 + n3) AS n, sum(yy) AS yy, sum(items * ln(1 + exp(x) * size)) AS ld, sum(items * size / (1 + exp(x) * size)) AS dl,
  {", ".join(f"sum(n{c}) AS t{c}, sum(s{c}) AS y{c}" for c in _FOUR)}, {_sums("exp(x) / (1 + exp(x) * size)", "w")}, {_sums("1 / pow(1 + exp(x) * size, 2)", "v")} FROM {points} JOIN k USING (grp) GROUP BY grp, x"""
    for step in steps:  # each in a selection of its own, or the expressions would be written into one another
        weighed = f"SELECT *, {step} FROM ({weighed})"
    return weighed


def _model(rows: str, levels: int = 9) -> str:
    """SQL of the mixed model of rows (grp, item, filler, gap, y): the best point of a grid, then ever narrower grids around the place where the slope is zero."""
    ctes = [
        f"rows AS ({rows})",
        "c AS (SELECT *, 3 - 2 * filler - gap AS cell, avg(y) OVER (PARTITION BY grp) AS centre FROM rows WHERE y IS NOT NULL AND NOT isnan(y))",
        f"i AS (SELECT grp, item, any_value(centre) AS centre, sum(pow(y - centre, 2)) AS yy, {', '.join(f'count(*) FILTER (cell = {c})::DOUBLE AS n{c}, coalesce(sum(y - centre) FILTER (cell = {c}), 0) AS s{c}' for c in _FOUR)} FROM c GROUP BY grp, item)",
        f"""k AS MATERIALIZED (SELECT grp, n0 + n1 + n2 + n3 AS size, any_value(centre) AS centre, count(*) AS items, sum(yy) AS yy, sum(pow(s0 + s1 + s2 + s3, 2)) AS ss, {", ".join(f"sum(n{c}) AS n{c}, sum(s{c}) AS s{c}" for c in _FOUR)},
  {", ".join(f"sum(n{c} * (s0 + s1 + s2 + s3)) AS h{c}" for c in _FOUR)}, {", ".join(f"sum(n{a} * n{b}) AS g{a}{b}" for a, b in _PAIRS)} FROM i GROUP BY ALL)""",
        "p0 AS (SELECT DISTINCT grp, -14 + i / 2 AS x FROM k, range(57) t(i))",
        f"e0 AS ({_solved('p0')})",
        "b0 AS MATERIALIZED (SELECT grp, arg_min(x, value) - 0.5 AS low, 1.0::DOUBLE AS width FROM e0 GROUP BY grp)",
    ]
    for n in range(1, levels):
        ctes.append(f"p{n} AS (SELECT grp, low, width, low + width * i / 20 AS x FROM b{n - 1}, range(21) t(i))")
        ctes.append(f"e{n} AS ({_solved(f'p{n}')})")
        ctes.append(f"b{n} AS MATERIALIZED (SELECT grp, coalesce(max(x) FILTER (slope < 0), any_value(low)) AS low, any_value(width) / 20 AS width FROM e{n} JOIN p{n} USING (grp, x) GROUP BY grp)")
    ctes.append(f"ends AS (SELECT grp, low + width / 2 AS x FROM b{levels - 1} UNION ALL SELECT grp, -1000 FROM b0)")
    ctes.append(f"m AS (SELECT * FROM ({_solved('ends')}) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY value) = 1)")
    effects = []
    for name, (c0, c1, c2, c3) in mixed.EFFECTS.items():
        f1, f2 = f"({c1} - l10 * {c0})", f"({c2} - l20 * {c0} - l21 * ({c1} - l10 * {c0}))"
        f3 = f"({c3} - l30 * {c0} - l31 * {f1} - l32 * {f2})"
        effects.append(f"{c0} * m0 + {c1} * m1 + {c2} * m2 + {c3} * m3{' + centre' if name == '0' else ''} AS b_{name}")
        effects.append(f"sqrt(rest / (n - 4) * (pow({c0}, 2) / d0 + pow({f1}, 2) / d1 + pow({f2}, 2) / d2 + pow({f3}, 2) / d3)) AS se_{name}")
    ctes.append(f"r AS (SELECT grp, n::BIGINT AS n_obs, n_items, rest / (n - 4) AS sigma2, exp(x) * rest / (n - 4) AS tau2, {', '.join(effects)} FROM m)")
    return "WITH " + ", ".join(ctes)


_SHOWN = [*(f"{what}_{name}" for what in ("b", "se") for name in mixed.EFFECTS), "sigma2", "tau2"]


@query(
    _model("SELECT l_returnflag AS grp, l_orderkey AS item, l_linenumber % 2 AS filler, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS gap, l_quantity + l_orderkey % 13 AS y FROM lineitem")
    + f" SELECT grp, n_obs, n_items, {', '.join(f'round({c}, 5) AS {c}' for c in _SHOWN)}, round(b_interaction / se_interaction, 5) AS z_interaction, "
    "round(-b_interaction - 1.959963984540054 * se_interaction, 5) AS licensing_low, round(-b_interaction + 1.959963984540054 * se_interaction, 5) AS licensing_high FROM r"
)
def mixed_model_unbalanced(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items, whose lines leave cells out and repeat others: a model for each return flag, every line counted."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("item"), (F.col("l_linenumber") % 2).alias("filler"), (F.col("l_linestatus") == "O").cast("int").alias("gap"),
        (F.col("l_quantity") + F.col("l_orderkey") % 13).alias("y"),
    )
    shown = [*_SHOWN, "z_interaction", "licensing_low", "licensing_high"]
    return mixed.fitted(rows, by=("grp",)).select("grp", "n_obs", "n_items", *(F.round(c, 5).alias(c) for c in shown))


_CURVES = """v AS (SELECT lang AS g, CAST(n_chars AS DOUBLE) AS v FROM documents WHERE n_chars IS NOT NULL),
s AS (SELECT g, count(*) AS n, min(v) AS least, max(v) AS most, stddev_samp(v) * pow(count(*), -0.2) AS width FROM v GROUP BY g HAVING stddev_samp(v) > 0),
e AS (SELECT min(least - 3 * width) AS low, (max(most + 3 * width) - min(least - 3 * width)) / 199 AS step FROM s),
b AS (SELECT g, least(floor((v - low) / step), 198)::INT AS bin, count(*) AS n_all, sum((v - low) / step - least(floor((v - low) / step), 198)) AS r FROM v, e GROUP BY ALL),
c AS (SELECT s.g, j AS point, low + j * step AS x, sum((n_all - r) * exp(-pow((j - bin) * step / width, 2) / 2) + r * exp(-pow((j - bin - 1) * step / width, 2) / 2)) / (any_value(s.n) * any_value(width) * sqrt(2 * pi())) AS density
  FROM s JOIN b ON s.g IS NOT DISTINCT FROM b.g, e, range(200) t(j) GROUP BY s.g, j, low, step)"""


@query(f"WITH {_CURVES} SELECT g AS lang, point::INT AS point, round(x, 4) AS x, round(density * 1000, 6) AS density FROM c")
def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    """The density of the lengths of texts, for each language."""
    got = density.gaussian(table(spark, d, "documents"), "n_chars", "lang")
    return got.withColumns({"x": F.round("x", 4), "density": F.round(F.col("density") * 1000, 6)})


@query(
    f"WITH {_CURVES} SELECT a.g AS \"left\", b.g AS \"right\", round(sum(least(a.density, b.density)) * any_value(step), 6) AS overlap FROM c a JOIN c b ON a.point = b.point, e WHERE a.g = 'en' AND b.g IN ('de', 'en', 'es', 'fr') GROUP BY ALL"
)
def density_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far the densities of other languages lie over that of one."""
    got = density.overlap(density.gaussian(table(spark, d, "documents"), "n_chars", "lang"), "lang", [("en", x) for x in ("de", "en", "es", "fr")])
    return got.withColumn("overlap", F.round("overlap", 6))


@query(
    """WITH p AS (SELECT vec_id // 2 AS pair_id, max(CASE WHEN vec_id % 2 = 0 THEN embedding END) AS src, max(CASE WHEN vec_id % 2 = 1 THEN embedding END) AS orc FROM embeddings GROUP BY 1),
e AS (SELECT unnest(src) AS s, unnest(orc) AS o, generate_subscripts(src, 1) - 1 AS unit FROM p WHERE src IS NOT NULL AND orc IS NOT NULL),
t AS (SELECT unit, avg(CAST(o AS DOUBLE) - CAST(s AS DOUBLE)) / (stddev_samp(CAST(o AS DOUBLE) - CAST(s AS DOUBLE)) / sqrt(count(*))) AS t FROM e GROUP BY unit),
k AS (SELECT greatest(1, ceil(0.1 * count(*)))::BIGINT AS k FROM t), top AS (SELECT 'selective' AS condition, unit FROM t QUALIFY row_number() OVER (ORDER BY t DESC, unit) <= (SELECT k FROM k)
UNION ALL SELECT 'random', unit FROM t QUALIFY row_number() OVER (ORDER BY md5('5|' || unit), unit) <= (SELECT k FROM k)),
x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS unit FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), c AS (SELECT label AS near, unit, avg(x) AS m FROM x GROUP BY label, unit),
f AS (SELECT condition, vec_id, label, near, sum(pow(CASE WHEN top.unit IS NULL THEN x ELSE 0 END - m, 2)) AS far FROM (SELECT unnest(['', 'selective', 'random']) AS condition) JOIN x ON true JOIN c USING (unit) LEFT JOIN top USING (condition, unit) GROUP BY condition, vec_id, label, near),
n AS (SELECT condition, vec_id, label, arg_min(near, (far, near)) AS near FROM f GROUP BY condition, vec_id, label), a AS (SELECT condition, count(*) AS n, avg(CASE WHEN near = label THEN 1.0 ELSE 0 END) AS accuracy FROM n GROUP BY condition)
SELECT condition, n, round(accuracy, 6) AS accuracy, round(accuracy - (SELECT accuracy FROM a WHERE condition = ''), 6) AS delta_accuracy FROM a"""
)
def unit_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The units that tell pairs apart most are silenced, and as many by chance: how much worse labels are told apart."""
    vectors = table(spark, d, "embeddings")
    side = lambda k: F.max(F.when(F.col("vec_id") % 2 == k, F.col("embedding")))
    pairs = vectors.groupBy(F.floor(F.col("vec_id") / 2)).agg(side(0).alias("src"), side(1).alias("orc")).where("src is not null and orc is not null")
    tests = stored(evaluate.paired_t(pairs, 16).select("flat_idx", "t_stat"), "unit-tests")
    chosen = evaluate.top_percent(tests, "t_stat", 10, "flat_idx").select("flat_idx")
    units = [r[0] for r in chosen.collect()]  # a tenth of a vector's units
    chance = [r[0] for r in tests.orderBy(sampling.draw("flat_idx", 5), "flat_idx").limit(len(units)).select("flat_idx").collect()]
    got = ablation.scored(vectors, {"selective": units, "random": chance})
    return got.select("condition", "n", F.round("accuracy", 6).alias("accuracy"), F.round("delta_accuracy", 6).alias("delta_accuracy"))
