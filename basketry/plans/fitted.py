"""Queries of fits, and of runs that hold fits, with twins that solve the same problems in SQL.

A twin's minimizer comes from cyclic coordinate descent in a recursive CTE (:func:`descent`), which shares nothing with the kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounting, compare, fit, moments, panel, risk, rules, schedule
from ..session import table
from . import market, queries, walkforward
from .queries import LOOKBACK, YEAR, M, Tables, query, rounded

SWEEPS = 1500


def _problem(source: str) -> str:
    """CTEs ``problem``: per universe the Gram matrix g (rows as lists), X'y as c, their size p, y'y and the dates n."""
    return f"""
, pa AS (SELECT universe, asset, row_number() OVER (PARTITION BY universe ORDER BY asset) AS i FROM (SELECT DISTINCT universe, asset FROM {source})
), px AS MATERIALIZED (SELECT s.universe, dt, i, x, y FROM {source} s JOIN pa ON pa.universe = s.universe AND pa.asset = s.asset
), py AS (SELECT universe, sum(y * y) AS yy, count(*) AS n FROM (SELECT universe, dt, any_value(y) AS y FROM {source} GROUP BY ALL) GROUP BY universe
), pg AS (SELECT a.universe, a.i, b.i AS j, sum(a.x * b.x) AS g FROM px a JOIN px b ON a.universe = b.universe AND a.dt = b.dt GROUP BY ALL
), pr_rows AS (SELECT universe, i, list(g ORDER BY j) AS own FROM pg GROUP BY ALL
), pr_c AS (SELECT universe, list(c ORDER BY i) AS c FROM (SELECT universe, i, sum(x * y) AS c FROM px GROUP BY ALL) GROUP BY universe
), problem AS MATERIALIZED (SELECT r.universe, list(own ORDER BY i) AS g, any_value(c) AS c, count(*) AS p, any_value(yy) AS yy, any_value(n) AS n FROM pr_rows r JOIN pr_c USING (universe) JOIN py USING (universe) GROUP BY r.universe)"""


#: One step of coordinate descent at place ``step % p``.
_STEP = "list_transform(w, lambda v, i: CASE WHEN i = step % p + 1 THEN greatest(0, (d[i] - list_dot_product(g[i], w) + g[i][i] * v) / greatest(g[i][i], 1e-12)) ELSE v END)"
_RSS = "yy - 2 * list_dot_product(c, w) + list_sum(list_transform(g, lambda own, i: w[i] * list_dot_product(own, w)))"


def descent(fractions: tuple[float, ...], source: str = "xm", sweeps: int = SWEEPS) -> str:
    """CTEs up to ``path``: universe, lam_idx, lam, n, p, w (by asset in order, see ``pa``), nnz, w_sum, rss and objective."""
    return (
        _problem(source)
        + f""", lams AS MATERIALIZED (SELECT *, list_transform(c, lambda v: v - lam) AS d FROM (SELECT *, CAST(k - 1 AS INT) AS lam_idx, f[k] * greatest(list_max(c), 1e-10) AS lam FROM problem, (SELECT {[*fractions]} AS f), range(1, {len(fractions) + 1}) r(k))
), walk AS (
  SELECT universe, lam_idx, 0 AS step, list_transform(c, lambda v: 0.0::DOUBLE) AS w FROM lams
  UNION ALL SELECT l.universe, l.lam_idx, step + 1, {_STEP} FROM walk JOIN lams l ON l.universe = walk.universe AND l.lam_idx = walk.lam_idx WHERE step < {sweeps} * p
), ended AS (SELECT l.*, w, list_sum(w) AS w_sum, len(list_filter(w, lambda v: v > 1e-9)) AS nnz, {_RSS} AS rss FROM walk JOIN lams l ON l.universe = walk.universe AND l.lam_idx = walk.lam_idx WHERE step = {sweeps} * p
), path AS MATERIALIZED (SELECT *, 0.5 * rss + lam * w_sum AS objective FROM ended) """
    )


#: The weights of ``path`` in money: divided by sigma, on the simplex, those below 1e-4 cut.
_MONEY = """, raw AS (SELECT universe, lam_idx, asset, w[i] / CASE WHEN sigma > 1e-12 THEN sigma ELSE 1 END AS v FROM path JOIN pa USING (universe) JOIN {stats} s USING (universe, asset) WHERE w[i] > 1e-9
), share AS (SELECT *, v / sum(v) OVER (PARTITION BY universe, lam_idx) AS s FROM raw
), money AS (SELECT universe, lam_idx, asset, s / sum(s) OVER (PARTITION BY universe, lam_idx) AS w FROM share WHERE s >= 1e-4) """


def _fits(t: Tables, methods=("fista",), **how) -> tuple[DataFrame, DataFrame]:
    x = table(t.train())
    return x, table(fit.fit_windows(x, methods, by=["universe"], **how))


def _scaled(*names: str):
    """Small sums of squares, times 10**4, so that rounding keeps their digits."""
    return [F.round(F.col(n) * 1e4, 5).alias(n) for n in names]


@query(descent(moments.FRACTIONS) + "SELECT universe, m AS method, lam_idx, nnz, round(objective * 1e4, 5) AS objective, round(w_sum, 6) AS w_sum FROM path, (SELECT unnest(['fista', 'cd', 'admm']) AS m)")
def fit_l1_path(spark, sf_dir):
    """Every penalty of three algorithms: active names, objective and weight."""
    _, fits = _fits(Tables(spark, sf_dir), ("fista", "cd", "admm"))
    total = F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + x["w"])
    return fits.select("universe", "method", "lam_idx", "nnz", *_scaled("objective"), F.round(total, 6).alias("w_sum"))


@query(descent((0.05, 0.2)) + "SELECT universe, lam_idx, asset, round(w[i], 6) AS w FROM path JOIN pa USING (universe) WHERE w[i] > 1e-6")
def fit_l1_weights(spark, sf_dir):
    _, fits = _fits(Tables(spark, sf_dir), fractions=(0.05, 0.2))
    return rounded(fit.fit_weights(fits, ["universe", "lam_idx"]).filter("w > 1e-6"))


@query(descent(moments.FRACTIONS) + "SELECT universe, lam_idx, round(rss * 1e4, 5) AS rss, round(objective * 1e4, 5) AS objective FROM path")
def fit_objective(spark, sf_dir):
    """Residual and objective from the data and the weights, not from the kernel's own numbers."""
    x, fits = _fits(Tables(spark, sf_dir))
    w = fits.select("universe", "lam_idx", "lam", F.inline_outer("weights")).withColumn("w", F.coalesce("w", F.lit(0.0)))
    made = fit.objective(x, w.withColumn("asset", F.coalesce("asset", F.lit(""))), ["universe", "lam_idx"])
    return made.select("universe", "lam_idx", *_scaled("rss", "objective"))


@query(descent((0.05,)) + "SELECT universe, round((objective - 0.5 * yy) * 1e4, 5) AS obj, true AS decreasing, true AS closed FROM path")
def fit_convergence(spark, sf_dir):
    """The trace ends at the least objective (without its constant y'y / 2), with no residual left."""
    _, fits = _fits(Tables(spark, sf_dir), fractions=(0.05,))
    steps = fit.convergence(fits, ["universe"])
    ends = steps.groupBy("universe").agg(F.min_by("obj", "iter").alias("first"), F.min("obj").alias("obj"), F.min("dual").alias("dual"))
    return ends.select("universe", *_scaled("obj"), (F.col("obj") <= F.col("first") + 1e-12).alias("decreasing"), (F.col("dual") <= 1e-8).alias("closed"))


def _score(gamma: float) -> str:
    scored = f"scored AS (SELECT *, n * ln(greatest(rss, 1e-300) / n) + nnz * ln(n) + 2 * {gamma} * nnz * ln(p) AS score FROM path)"
    return descent(moments.FRACTIONS) + f", {scored} SELECT universe, lam_idx, nnz, round(score, 4) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY universe ORDER BY score, lam_idx) = 1"


def _selected(spark, sf_dir, gamma):
    _, fits = _fits(Tables(spark, sf_dir))
    best = moments.select_lambda(fit.score_path(fits, gamma).select("universe", "lam_idx", "nnz", "score"), ["universe"])
    return rounded(best, 4)


@query(_score(0.0))
def bic_select(spark, sf_dir):
    return _selected(spark, sf_dir, None)


@query(_score(0.5))
def ebic_select(spark, sf_dir):
    return _selected(spark, sf_dir, 0.5)


_RELAXED = (0.0001, 0.0003, 0.001, 0.003)


def reweighting_steps(fractions: tuple[float, ...], sweeps: int = SWEEPS // 3, relative: bool = False, name: str = "rw") -> str:
    """CTEs up to ``{name}_last`` (universe, lam_idx, w by place) of reweighted fits: five rounds of cyclic descent, each with penalties from the weights before it, that end with a stable support."""
    penalty = "lam * (list_max(new) / list_sum(new) + 1e-3) / (new[i] / list_sum(new) + 1e-3)" if relative else "lam / (new[i] + 1e-3)"
    bare = " OR list_sum(new) = 0" if relative else ""
    return f""", {name}_lams AS MATERIALIZED (SELECT *, CAST(k - 1 AS INT) AS lam_idx, f[k] * greatest(list_max(c), 1e-10) AS lam FROM problem, (SELECT {[*fractions]} AS f), range(1, {len(fractions) + 1}) r(k)
), {name}_walk AS (
  SELECT universe, lam_idx, 0 AS step, list_transform(c, lambda v: 0.0::DOUBLE) AS w, list_transform(c, lambda v: v - lam) AS d, list_transform(c, lambda v: NULL::BOOLEAN) AS before, false AS done FROM {name}_lams
  UNION ALL SELECT universe, lam_idx, step + 1, new, CASE WHEN at_end AND NOT ends THEN list_transform(c, lambda v, i: v - {penalty}) ELSE d END, CASE WHEN at_end THEN support ELSE before END, done OR (at_end AND ends)
  FROM (SELECT *, (step + 1) % ({sweeps} * p) = 0 AS at_end, list_transform(new, lambda v: v > 1e-8) AS support, list_transform(new, lambda v: v > 1e-8) = before{bare} AS ends
    FROM (SELECT l.*, step, w, d, before, done, {_STEP} AS new FROM {name}_walk k JOIN {name}_lams l ON l.universe = k.universe AND l.lam_idx = k.lam_idx WHERE step < 5 * {sweeps} * p AND NOT done))
), {name}_last AS MATERIALIZED (SELECT universe, lam_idx, w FROM {name}_walk QUALIFY row_number() OVER (PARTITION BY universe, lam_idx ORDER BY step DESC) = 1)"""


def reweighting(fractions: tuple[float, ...], source: str = "xm", sweeps: int = SWEEPS // 3) -> str:
    """The weights of reweighted fits, one row each."""
    return _problem(source) + reweighting_steps(fractions, sweeps) + " SELECT l.universe, l.lam_idx, asset, round(w[i], 6) AS w FROM rw_last l JOIN pa ON pa.universe = l.universe WHERE w[i] > 1e-6"


@query(reweighting(_RELAXED))
def reweighted(spark, sf_dir):
    """Reweighted fits at small penalties: lam / (w + epsilon), until the support is stable."""
    t = Tables(spark, sf_dir)
    fits = fit.fit_windows(table(t.train()), ("reweighted",), _RELAXED, by=["universe"])
    return rounded(fit.fit_weights(fits, ["universe", "lam_idx"]).filter("w > 1e-6"))


@query(
    """, c AS (SELECT universe, asset, sum(x * y) AS c, sum(x * x) AS g FROM xm GROUP BY ALL), one AS (SELECT universe, asset AS a1, c AS c1, g AS g1 FROM c WHERE c > 1e-12 QUALIFY row_number() OVER (PARTITION BY universe ORDER BY c DESC, asset) = 1),
    h AS (SELECT x.universe, x.asset, sum(x.x * z.x) AS h FROM xm x JOIN one ON one.universe = x.universe JOIN xm z ON z.universe = x.universe AND z.asset = a1 AND z.dt = x.dt GROUP BY ALL),
    two AS (SELECT one.*, c.asset AS a2, c.c AS c2, c.g AS g2, h FROM one JOIN c USING (universe) JOIN h ON h.universe = c.universe AND h.asset = c.asset WHERE c.asset <> a1 AND c.c - h * c1 / g1 > 1e-12 QUALIFY row_number() OVER (PARTITION BY c.universe ORDER BY c.c - h * c1 / g1 DESC, c.asset) = 1),
    w AS (SELECT universe, a1, a2, (c1 * g2 - c2 * h) / (g1 * g2 - h * h) AS u, (c2 * g1 - c1 * h) / (g1 * g2 - h * h) AS v, c2 / g2 AS single FROM two)
    SELECT universe, a1 AS asset, round(u, 6) AS w FROM w WHERE u > 0 UNION ALL SELECT universe, a2, round(CASE WHEN u > 0 THEN v ELSE single END, 6) FROM w
    UNION ALL SELECT universe, a1, round(c1 / g1, 6) FROM one WHERE universe NOT IN (SELECT universe FROM two)"""
)
def omp_two(spark, sf_dir):
    """The greedy fit of two assets, which has a closed form."""
    _, fits = _fits(Tables(spark, sf_dir), ("omp",), cardinality=2)
    return rounded(fit.fit_weights(fits, ["universe"]))


def greedy_steps(k: int, sweeps: int = 600) -> str:
    """CTEs up to ``picks``: universe, iter, s (the chosen places in order), w, rss and the largest product left, after each step of the greedy fit.

    A step picks a place and then goes ``sweeps`` times round the chosen ones by cyclic descent.
    """
    corr = "list_transform(c, lambda v, i: CASE WHEN list_contains(s, i) THEN -1e300 ELSE v - list_dot_product(g[i], w) END)"
    turn = "list_transform(w, lambda v, i: CASE WHEN i = s[t % len(s) + 1] THEN greatest(0, (c[i] - list_dot_product(g[i], w) + g[i][i] * v) / greatest(g[i][i], 1e-12)) ELSE v END)"
    return f""", greedy AS (
  SELECT universe, 0 AS step, 0 AS t, []::BIGINT[] AS s, list_transform(c, lambda v: 0.0::DOUBLE) AS w, false AS done FROM problem
  UNION ALL SELECT universe, step + 1, CASE WHEN t > 0 THEN (t + 1) % ({sweeps} * len(s) + 1) WHEN list_max(corr) > 1e-12 THEN 1 ELSE 0 END, CASE WHEN t = 0 AND list_max(corr) > 1e-12 THEN list_append(s, list_position(corr, list_max(corr))) ELSE s END,
    CASE WHEN t = 0 THEN w ELSE {turn} END, t = 0 AND NOT list_max(corr) > 1e-12
  FROM (SELECT problem.*, step, t, s, w, CASE WHEN t = 0 THEN {corr} END AS corr FROM greedy JOIN problem ON problem.universe = greedy.universe WHERE NOT done AND NOT (t = 0 AND len(s) = {k}))
), picks AS MATERIALIZED (SELECT problem.*, len(s) AS iter, s, w, greatest({_RSS}, 0) AS rss, list_max(list_transform(c, lambda v, i: v - list_dot_product(g[i], w))) AS left_over FROM greedy JOIN problem ON problem.universe = greedy.universe WHERE t = 0 AND len(s) > 0 AND NOT done) """


def greedy(k: int, source: str = "xm", sweeps: int = 600) -> str:
    return _problem(source) + greedy_steps(k, sweeps)


@query(greedy(8) + "SELECT universe, CAST(iter AS INT) AS iter, round(rss * 1e4, 5) AS primal, round(left_over * 1e4, 5) AS dual FROM picks")
def omp_k(spark, sf_dir):
    """The greedy fit's steps up to eight assets: size, residual and largest correlation left."""
    _, fits = _fits(Tables(spark, sf_dir), ("omp",), cardinality=8)
    steps = fit.convergence(fits, ["universe"])
    return steps.select("universe", "iter", *_scaled("primal", "dual"))


@query(
    _problem("xm")
    + """, power AS (
  SELECT universe, 0 AS step, list_transform(c, lambda v, i: 1.0 + i / 100.0) AS v, 0.0::DOUBLE AS norm FROM problem
  UNION ALL SELECT universe, step + 1, list_transform(u, lambda z: z / sqrt(list_dot_product(u, u))), sqrt(list_dot_product(u, u)) FROM (SELECT power.universe, step, list_transform(g, lambda own: list_dot_product(own, v)) AS u FROM power JOIN problem ON problem.universe = power.universe WHERE step < 3000)
) SELECT problem.universe, p, round(norm, 4) AS eigenvalue FROM power JOIN problem ON problem.universe = power.universe WHERE step = 3000"""
)
def largest_eigenvalue(spark, sf_dir):
    return rounded(moments.largest_eigenvalue(Tables(spark, sf_dir).train(), ["universe"]), 4)


@query(
    descent(moments.FRACTIONS)
    + _MONEY.format(stats="st")
    + """, pb AS (SELECT universe, lam_idx, split, dt, sum(w * r) AS p, any_value(tt.y) AS b FROM tt JOIN money USING (universe, asset) GROUP BY ALL
), scored AS (SELECT universe, lam_idx, 1 - sum((b - p) * (b - p)) FILTER (split = 'train') / (var_pop(b) FILTER (split = 'train') * count(*) FILTER (split = 'train')) AS r2, stddev_pop(p - b) FILTER (split = 'test') * sqrt(12) AS te FROM pb GROUP BY ALL
), names AS (SELECT universe, lam_idx, count(*) FILTER (w > 1e-6) AS n_active FROM money GROUP BY ALL)
SELECT universe, lam_idx, round(lam, 7) AS lam, nnz, coalesce(n_active, 0) AS n_active, round(objective * 1e4, 5) AS objective, round(r2, 5) AS in_sample_r2, round(te, 6) AS oos_te
FROM path LEFT JOIN names USING (universe, lam_idx) LEFT JOIN scored USING (universe, lam_idx)"""
)
def lambda_path(spark, sf_dir):
    """Every penalty of the path: active names, objective, R2 on the training dates and tracking error on the test dates."""
    t = Tables(spark, sf_dir)
    rows = table(t.train_test())
    fits, w = compare.split_fit(rows, ("admm",), moments.FRACTIONS)
    by = ["universe", "lam_idx"]
    scored = compare.in_vs_out(compare.split_curves(rows, w.drop("method"), ["lam_idx"]), by, YEAR["month"])
    size = w.groupBy(*by).agg(F.count(F.when(F.col("w") > 1e-6, 1)).alias("n_active"))
    path = fits.select(*by, "lam", "nnz", "objective").join(size, by, "left").join(scored, by, "left")
    zero = F.lit(0).cast("long")
    return path.select(*by, F.round("lam", 7).alias("lam"), "nnz", F.coalesce("n_active", zero).alias("n_active"), *_scaled("objective"), F.round("r2_train", 5).alias("in_sample_r2"), F.round(F.col("te_test") / 100, 6).alias("oos_te"))


_LAST = """, l36 AS (SELECT rm.universe, rm.dt, rm.asset, rm.r FROM rm JOIN full_m USING (universe, asset) QUALIFY dense_rank() OVER (PARTITION BY rm.universe ORDER BY rm.dt DESC) <= 36
), lx AS MATERIALIZED (SELECT l36.*, ym.r AS y, stddev_pop(l36.r) OVER v AS sigma, (l36.r - avg(l36.r) OVER v) / CASE WHEN stddev_pop(l36.r) OVER v > 1e-12 THEN stddev_pop(l36.r) OVER v ELSE 1 END AS x
  FROM l36 JOIN ym USING (universe, dt) WINDOW v AS (PARTITION BY universe, asset))"""


@query(
    _LAST
    + descent((0.05,), "lx")
    + _MONEY.format(stats="(SELECT DISTINCT universe, asset, sigma FROM lx)")
    + """, pb AS (SELECT universe, dt, sum(w * r) AS p, any_value(lx.y) AS b FROM lx JOIN money USING (universe, asset) GROUP BY ALL), one AS (SELECT universe, count(*) FILTER (w > 1e-6) AS n_active, sum(w) AS w_sum, max(w) AS w_max FROM money GROUP BY universe)
SELECT universe, n_active, round(w_sum, 6) AS w_sum, round(w_max, 6) AS w_max, round(r2, 5) AS r2 FROM one JOIN (SELECT universe, 1 - sum((b - p) * (b - p)) / (var_pop(b) * count(*)) AS r2 FROM pb GROUP BY universe) USING (universe)"""
)
def retrain_latest(spark, sf_dir):
    """A retrain on the last 36 months of every universe, from prices to weights and in-sample R2."""
    t = Tables(spark, sf_dir)
    base = panel.varying_assets(panel.last_n(panel.complete_assets(t.monthly()), 36))
    x = table(panel.standardize(panel.align(base, t.bench()), True))
    fits = fit.fit_windows(x, ("fista",), (0.05,), by=["universe"])
    w = table(rules.destandardize(fit.fit_weights(fits, ["universe"]), x.select("universe", "asset", "sigma").distinct(), ["universe"]))
    m = compare.holdout_metrics(w, x, x.select("universe", "dt", F.col("y").alias("r")).distinct(), [], YEAR["month"])
    one = w.groupBy("universe").agg(F.sum("w").alias("w_sum"), F.max("w").alias("w_max"))
    return rounded(one.join(m, "universe").select("universe", "n_active", "w_sum", "w_max", F.round("r2", 5).alias("r2")))


_CAPPED = (15, 12)  # universes of more than so many listed assets keep the first so many
_CHAIN = (
    """, listed AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY asset) AS ord, count(*) OVER (PARTITION BY universe) AS n_listed FROM (SELECT DISTINCT universe, asset FROM ln)),
inside AS (SELECT * FROM listed WHERE n_listed <= {0} OR ord <= {1}), own AS (SELECT rm.* FROM rm JOIN inside USING (universe, asset)), n_own AS (SELECT universe, count(DISTINCT dt) AS n FROM own GROUP BY universe),
whole_own AS (SELECT universe, asset FROM own JOIN n_own USING (universe) GROUP BY universe, asset, n HAVING count(*) = n),
used AS (SELECT u.universe, CASE WHEN u.universe > 'B' THEN u.universe ELSE 'ASIA' END AS benchmark_used FROM (SELECT DISTINCT universe FROM rm) u),
c36 AS (SELECT own.* FROM own JOIN whole_own USING (universe, asset) QUALIFY dense_rank() OVER (PARTITION BY own.universe ORDER BY dt DESC) <= 36),
cx AS MATERIALIZED (SELECT c36.*, ym.r AS y, benchmark_used, stddev_pop(c36.r) OVER v AS sigma, (c36.r - avg(c36.r) OVER v) / CASE WHEN stddev_pop(c36.r) OVER v > 1e-12 THEN stddev_pop(c36.r) OVER v ELSE 1 END AS x
  FROM c36 JOIN used ON used.universe = c36.universe JOIN ym ON ym.universe = benchmark_used AND ym.dt = c36.dt WINDOW v AS (PARTITION BY c36.universe, c36.asset))""".format(*_CAPPED)
    + descent((0.05,), "cx")
    + _MONEY.format(stats="(SELECT DISTINCT universe, asset, sigma FROM cx)")
    + """, pb AS (SELECT universe, dt, sum(w * r) AS p, any_value(cx.y) AS b FROM cx JOIN money USING (universe, asset) GROUP BY ALL), one AS (SELECT universe, count(*) FILTER (w > 1e-6) AS n_active, max(w) AS w_max FROM money GROUP BY universe),
src AS (SELECT universe, any_value(n_listed) AS n_listed FROM listed GROUP BY universe)
SELECT src.universe, n_listed, n_listed > {} AS capped, benchmark_used, n_active, round(w_max, 6) AS w_max, round(r2, 5) AS r2 FROM src JOIN used USING (universe) LEFT JOIN one USING (universe)
LEFT JOIN (SELECT universe, 1 - sum((b - p) * (b - p)) / (var_pop(b) * count(*)) AS r2 FROM pb GROUP BY universe) z USING (universe)""".format(_CAPPED[0])
)


def retrain(returns: DataFrame, listed: DataFrame, candidates: DataFrame, n_dates: int, lam_frac: float = 0.05, threshold: int = 750, keep: int = 120) -> dict[str, DataFrame]:
    """A retrain from lists and prices to weights: universes that are too large keep the head of their list, and each takes its first benchmark candidate that has prices.

    ``listed``: universe, asset, ord; ``candidates``: universe, rank, candidate, dt, price. weights: universe, asset, w. report: universe, n_listed, capped, benchmark_used, iterations, converged, n_active, w_max, r2.
    """
    kept = panel.cap_universe(listed, threshold, keep)
    size = listed.groupBy("universe").agg(F.count(F.lit(1)).alias("n_listed")).withColumn("capped", F.col("n_listed") > threshold)
    quotes = table(panel.benchmark_fallback(candidates))
    bench = panel.simple_returns(quotes.select("universe", "dt", F.col("candidate").alias("asset"), "price")).drop("asset")
    own = returns.join(kept.select("universe", "asset"), ["universe", "asset"], "left_semi")
    base = panel.varying_assets(panel.last_n(panel.complete_assets(own), n_dates))
    x = table(panel.standardize(panel.align(base, bench), True))
    fits = table(fit.fit_windows(x, ("admm",), (lam_frac,), by=["universe"]))
    w = table(rules.destandardize(fit.fit_weights(fits, ["universe"]), x.select("universe", "asset", "sigma").distinct(), ["universe"]))
    scored = compare.holdout_metrics(w, x, x.select("universe", "dt", F.col("y").alias("r")).distinct(), [], YEAR["month"]).select("universe", "n_active", "r2")
    used = quotes.groupBy("universe").agg(F.first("candidate").alias("benchmark_used"))
    most = w.groupBy("universe").agg(F.max("w").alias("w_max"))
    report = size.join(used, "universe", "left").join(fits.select("universe", "iterations", "converged"), "universe", "left").join(scored, "universe", "left").join(most, "universe", "left")
    return {"weights": w, "report": report}


@query(_CHAIN)
def retrain_chain(spark, sf_dir):
    """The whole retrain on lists that are too long and benchmarks that are partly missing: some universes fall back to another one's."""
    t = Tables(spark, sf_dir)
    listed = t.lines.select("universe", "asset").distinct().withColumn("ord", F.lit(0))
    price = table(market.benchmark(t.totals("month"))).select("universe", "dt", "price")
    own = price.select("universe", F.lit(0).alias("rank"), F.col("universe").alias("candidate"), "dt", F.when(F.col("universe") > "B", F.col("price")).alias("price"))
    asia = price.filter("universe = 'ASIA'").select(F.lit("ASIA").alias("candidate"), "dt", "price")
    other = price.select("universe", "dt").join(asia, "dt").select("universe", F.lit(1).alias("rank"), "candidate", "dt", "price")
    report = retrain(t.monthly(), listed, own.unionByName(other), 36, 0.05, *_CAPPED)["report"]
    return report.select("universe", "n_listed", "capped", "benchmark_used", "n_active", F.round("w_max", 6).alias("w_max"), F.round("r2", 5).alias("r2"))


# ---- comparisons with fits -------------------------------------------------------------------------

#: Training caps and the rules' weights; metrics on the test dates of weights ``allw2`` (universe, method, step, asset, w).
_TRAIN_CAPS = (
    queries._RANKED
    + """,
rpick AS (SELECT universe, asset, 1.0 / count(*) OVER (PARTITION BY universe, k) AS w1 FROM (SELECT universe, asset, k, row_number() OVER (PARTITION BY universe, k ORDER BY md5(k || ':' || asset), asset) AS rn FROM tcap, range(100) t(k)) WHERE rn <= 10),
rmean AS (SELECT universe, asset, w1 / sum(w1) OVER (PARTITION BY universe) AS w FROM (SELECT universe, asset, sum(w1) AS w1 FROM rpick GROUP BY universe, asset))"""
)
_HELD_OUT = """, pr2 AS (SELECT universe, method, step, dt, sum(w * r) AS p, any_value(y) AS b FROM tt JOIN allw2 USING (universe, asset) WHERE split = 'test' GROUP BY ALL),
size2 AS (SELECT universe, method, step, count(*) FILTER (w > 1e-6) AS n_active FROM allw2 GROUP BY ALL),
held2 AS (SELECT universe, method, step, 1 - sum((b - p) * (b - p)) / (var_pop(b) * count(*)) AS r2, stddev_samp(p - b) * sqrt(12) AS te, avg(p - b) / stddev_samp(p - b) * sqrt(12) AS ir, avg(p) / stddev_samp(p) * sqrt(12) AS sharpe FROM pr2 GROUP BY ALL),
final2 AS (SELECT * FROM held2 JOIN size2 USING (universe, method, step)) """
_LADDER = (
    descent(compare.LADDER)
    + _MONEY.format(stats="st")
    + _TRAIN_CAPS
    + """, first2 AS (SELECT universe, min(lam_idx) AS lam_idx FROM money GROUP BY universe), allw2 AS (
  SELECT universe, m AS method, 0 AS step, asset, w FROM money JOIN first2 USING (universe, lam_idx), (SELECT unnest(['fista', 'cd', 'admm']) AS m)
  UNION ALL SELECT universe, 'cap', 0, asset, cap / sum(cap) OVER (PARTITION BY universe) FROM trank WHERE rn <= 10 UNION ALL SELECT universe, 'equal', 0, asset, 1.0 / count(*) OVER (PARTITION BY universe) FROM trank WHERE rn <= 10
  UNION ALL SELECT universe, 'random', 0, asset, w FROM rmean)"""
    + _HELD_OUT
)
_L1 = ("fista", "cd", "admm")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in (("r2", 4), ("te", 6), ("ir", 5), ("sharpe", 5)) if c in df.columns})


@query(_LADDER + "SELECT universe, method, n_active, round(r2, 4) AS r2, round(te, 6) AS te, round(ir, 5) AS ir, round(sharpe, 5) AS sharpe FROM final2")
def comparison_fitted(spark, sf_dir):
    """Two rules and three fits on one split: fitted and ranked on its training dates, scored on its test dates."""
    return _shown(queries._all_holdout(Tables(spark, sf_dir), _L1).select("universe", "method", "n_active", "r2", "te", "ir", "sharpe"))


@query(_LADDER + "SELECT universe, n_active, round(r2, 4) AS r2, round(te, 6) AS te FROM final2 WHERE method = 'admm'")
def headline_admm(spark, sf_dir):
    """The fit's row of every universe."""
    return _shown(compare.headline(queries._all_holdout(Tables(spark, sf_dir), ("admm",)), "admm", ["n_active", "r2", "te"]))


@query(_LADDER + "SELECT u.universe, n_active, round(r2, 4) AS r2, CASE WHEN n_active IS NULL THEN 'no weights' END AS error FROM (SELECT r_name AS universe FROM region UNION ALL SELECT 'nowhere') u LEFT JOIN final2 f ON f.universe = u.universe AND method = 'admm'")
def multi_universe_fitted(spark, sf_dir):
    """The fit of every universe; one without data stays as a row with a reason."""
    t = Tables(spark, sf_dir)
    universes = t.read("region").select(F.col("r_name").alias("universe")).unionByName(spark.range(1).select(F.lit("nowhere").alias("universe")))
    found = compare.headline(queries._all_holdout(t, ("admm",)), "admm", ["n_active", "r2"])
    return _shown(compare.with_failures(universes, found, F.lit("no weights")))


@query(
    descent(moments.FRACTIONS)
    + _MONEY.format(stats="st")
    + _TRAIN_CAPS
    + """, allw2 AS (SELECT universe, 'fista' AS method, lam_idx AS step, asset, w FROM money UNION ALL SELECT universe, 'cap', k, asset, cap / sum(cap) OVER (PARTITION BY universe, k) FROM trank, (SELECT unnest([3, 5, 8, 12]) AS k) WHERE rn <= k)"""
    + _HELD_OUT
    + "SELECT universe, method, step, n_active, round(te, 6) AS te, round(r2, 4) AS r2 FROM final2"
)
def sweep_fitted(spark, sf_dir):
    """A sweep of penalties beside one of cardinalities, scored on the test dates."""
    t = Tables(spark, sf_dir)
    rows = table(t.train_test())
    caps = table(queries._train_caps(rows, t.prices("month").drop("price")))
    _, path = compare.split_fit(rows, ("fista",), moments.FRACTIONS)
    sweep = path.withColumnRenamed("lam_idx", "step")
    for n in (3, 5, 8, 12):
        sweep = sweep.unionByName(rules.top_n_cap(caps, n, ["universe"]).select("universe", F.lit("cap").alias("method"), F.lit(n).alias("step"), "asset", "w"))
    return _shown(queries._on_test(rows, table(sweep), ["method", "step"]).select("universe", "method", "step", "n_active", "te", "r2"))


_REGIME_DATA = f""", {queries._REGIMES}, rall AS (SELECT rw.universe || '|' || regime AS universe, type, rw.dt, asset, rw.r, yw.r AS y FROM rw JOIN reg ON rw.dt >= start_dt AND rw.dt < end_dt JOIN yw ON yw.universe = rw.universe AND yw.dt = rw.dt),
rnum AS (SELECT *, dense_rank() OVER (PARTITION BY universe ORDER BY dt) AS k FROM rall), rlong AS (SELECT universe FROM rnum GROUP BY universe HAVING max(k) >= 30),
rsplit AS MATERIALIZED (SELECT *, CASE WHEN k <= 20 THEN 'train' ELSE 'test' END AS split FROM rnum WHERE k <= 30 AND universe IN (SELECT universe FROM rlong)),
rst AS (SELECT universe, asset, avg(r) AS mu, stddev_pop(r) AS sigma FROM rsplit WHERE split = 'train' GROUP BY ALL HAVING var_pop(r) > 1e-12),
rx AS MATERIALIZED (SELECT s.universe, dt, asset, y, (r - mu) / CASE WHEN sigma > 1e-12 THEN sigma ELSE 1 END AS x FROM rsplit s JOIN rst USING (universe, asset) WHERE split = 'train')"""
_REGIME = (
    _REGIME_DATA
    + descent(compare.LADDER[:1], "rx", 800)
    + _MONEY.format(stats="rst")
    + """, rp AS (SELECT universe, any_value(type) AS type, split, dt, sum(w * r) AS p, any_value(y) AS b FROM rsplit JOIN money USING (universe, asset) GROUP BY universe, split, dt),
rm2 AS (SELECT universe, any_value(type) AS type, 1 - sum((b - p) * (b - p)) FILTER (split = 'test') / (var_pop(b) FILTER (split = 'test') * count(*) FILTER (split = 'test')) AS r2, stddev_pop(p - b) FILTER (split = 'test') * sqrt(52) * 100 AS te, corr(p, b) FILTER (split = 'test') AS co FROM rp GROUP BY universe),
rn2 AS (SELECT universe, count(*) FILTER (w > 1e-6) AS n_active FROM money GROUP BY universe) """
)


@query(_REGIME + "SELECT split_part(universe, '|', 1) AS universe, split_part(universe, '|', 2) AS regime, type, n_active, round(r2, 3) AS r2, round(te, 4) AS te_pct, round(co, 4) AS correlation, r2 > 0.5 AND te < 15 AS passed FROM rm2 JOIN rn2 USING (universe)")
def regime_fitted(spark, sf_dir):
    """One fit per universe and regime, on the regime's own training dates, judged on its test dates."""
    from .compared import _regime_fits

    rows = _regime_fits(Tables(spark, sf_dir), ("admm",)).filter("method = 'admm'")
    return rows.select("universe", "regime", "type", "n_active", F.round("r2", 3).alias("r2"), F.round("te_pct", 4).alias("te_pct"), F.round("corr_test", 4).alias("correlation"), "passed")


# ---- runs ------------------------------------------------------------------------------------------


#: The prelude with other books: ``wts`` are those of the fits, and NAV follows from them.
_OWN_BOOKS = "wts AS (\n  SELECT * FROM w_cap UNION ALL SELECT * FROM w_eq\n)"
assert _OWN_BOOKS in queries.PRELUDE


def books(ctes: str) -> str:
    """PRELUDE with ``ctes``, which end in fw (universe, rebal_dt, asset, v: weights in money, not scaled), as books of the method ``fit``; windows without any weight are uniform."""
    return queries.PRELUDE.replace(
        _OWN_BOOKS,
        ctes
        + """, fshare AS (SELECT universe, rebal_dt, asset, v / sum(v) OVER (PARTITION BY universe, rebal_dt) AS s FROM fw WHERE v > 0
), fkept AS (SELECT universe, rebal_dt, asset, s / sum(s) OVER (PARTITION BY universe, rebal_dt) AS w FROM fshare WHERE s >= 1e-4
), fbare AS (SELECT DISTINCT universe, rebal_dt, asset FROM win ANTI JOIN fkept USING (universe, rebal_dt)
), wts AS (
  SELECT universe, 'fit' AS method, rebal_dt, asset, w FROM fkept UNION ALL SELECT universe, 'fit', rebal_dt, asset, 1.0 / count(*) OVER (PARTITION BY universe, rebal_dt) FROM fbare
)""",
    )


#: Windows' returns over their own deviations, and the benchmark.
_WINDOW_X = """wx AS MATERIALIZED (SELECT w.universe, w.rebal_dt, w.dt, w.asset, y.r AS y, sigma, w.r / sigma AS x
  FROM (SELECT *, CASE WHEN stddev_pop(r) OVER v > 1e-12 THEN stddev_pop(r) OVER v ELSE 1 END AS sigma FROM win WINDOW v AS (PARTITION BY universe, rebal_dt, asset)) w JOIN yw y USING (universe, dt))"""


@query(
    "SELECT universe, dt, round(nav, 4) AS nav FROM nav",
    books(
        _WINDOW_X
        + """, mc AS (SELECT universe, rebal_dt, asset, sum(x * y) AS c, sum(x * x) AS g, any_value(sigma) AS sigma FROM wx GROUP BY ALL
), m1 AS (SELECT universe, rebal_dt, asset AS a1, c AS c1, g AS g1, sigma AS s1 FROM mc WHERE c > 1e-12 QUALIFY row_number() OVER (PARTITION BY universe, rebal_dt ORDER BY c DESC, asset) = 1
), mh AS (SELECT x.universe, x.rebal_dt, x.asset, sum(x.x * z.x) AS h FROM wx x JOIN m1 ON m1.universe = x.universe AND m1.rebal_dt = x.rebal_dt JOIN wx z ON z.universe = x.universe AND z.rebal_dt = x.rebal_dt AND z.asset = a1 AND z.dt = x.dt GROUP BY ALL
), m2 AS (SELECT m1.*, k.asset AS a2, k.c AS c2, k.g AS g2, k.sigma AS s2, h FROM m1 JOIN mc k USING (universe, rebal_dt) JOIN mh ON mh.universe = k.universe AND mh.rebal_dt = k.rebal_dt AND mh.asset = k.asset
  WHERE k.asset <> a1 AND k.c - h * c1 / g1 > 1e-12 QUALIFY row_number() OVER (PARTITION BY k.universe, k.rebal_dt ORDER BY k.c - h * c1 / g1 DESC, k.asset) = 1
), m3 AS (SELECT *, (c1 * g2 - c2 * h) / (g1 * g2 - h * h) AS u, (c2 * g1 - c1 * h) / (g1 * g2 - h * h) AS v FROM m2
), fw AS (SELECT universe, rebal_dt, a1 AS asset, u / s1 AS v FROM m3 WHERE u > 0 UNION ALL SELECT universe, rebal_dt, a2, CASE WHEN u > 0 THEN v ELSE c2 / g2 END / s2 FROM m3
  UNION ALL SELECT universe, rebal_dt, a1, c1 / g1 / s1 FROM m1 ANTI JOIN m2 USING (universe, rebal_dt))"""
    ),
)
def walkforward_greedy(spark, sf_dir):
    """NAV on every date of a run with a greedy fit of two assets a month, on rolling moments; the twin has its closed form in every window."""
    nav = Tables(spark, sf_dir).run(("omp",), {"k": 2})["nav"]
    return rounded(nav.drop("method"), 4)


_SPAN = ("1996-01-01", "1996-12-31")


def _window_problem() -> str:
    """CTEs ``problem`` of :func:`_problem` for each window of the span, named universe|date."""
    keyed = f"kx AS MATERIALIZED (SELECT universe || '|' || rebal_dt AS universe, asset, dt, x, y, sigma FROM wx WHERE rebal_dt BETWEEN '{_SPAN[0]}' AND '{_SPAN[1]}')"
    return f"{_WINDOW_X}, {keyed}" + descent((0.05,), "kx", 500)


@query(
    "SELECT rebal_dt, universe, asset, round(w, 5) AS w FROM wts WHERE w > 1e-3",
    books(
        _window_problem()
        + """, fw AS (SELECT split_part(path.universe, '|', 1) AS universe, CAST(split_part(path.universe, '|', 2) AS DATE) AS rebal_dt, pa.asset, w[pa.i] / sigma AS v
  FROM path JOIN pa ON pa.universe = path.universe JOIN (SELECT DISTINCT universe, asset, sigma FROM kx) s ON s.universe = path.universe AND s.asset = pa.asset WHERE w[pa.i] > 1e-9)"""
    ).replace("ANTI JOIN fkept USING (universe, rebal_dt)", f"ANTI JOIN fkept USING (universe, rebal_dt) WHERE rebal_dt BETWEEN '{_SPAN[0]}' AND '{_SPAN[1]}'"),
)
def walkforward_books(spark, sf_dir):
    """The books of a penalized fit at every rebalance of a year, on rolling moments; the twin solves every window by descent."""
    t = Tables(spark, sf_dir)
    config = walkforward.Config(methods=("fista",), lookback=LOOKBACK, start=_SPAN[0], end=_SPAN[1])
    return rounded(walkforward.target_weights(table(t.weekly()), t.bench("week"), config).drop("method").filter("w > 1e-3"), 5)


@query(
    """, books AS (SELECT universe, count(*) AS n_books FROM sched WHERE rpos >= 26 GROUP BY universe), days AS (SELECT universe, count(*) AS n_dates FROM cal GROUP BY universe),
    first AS (SELECT universe, arg_min(nav, dt) AS first_nav, arg_max(nav, dt) AS opening_nav FROM early WHERE method = 'equal_cap' GROUP BY universe)
    SELECT universe, m AS method, n_dates, round(first_nav, 4) AS first_nav, round(opening_nav, 4) AS opening_nav, n_books, n_books AS n_on_simplex FROM days JOIN books USING (universe) JOIN first USING (universe), (SELECT unnest(['fista', 'omp']) AS m)"""
)
def walkforward_fitted(spark, sf_dir):
    """A full run with fitted methods: NAV on every date, from the capital and cash on, and books on the simplex."""
    out = Tables(spark, sf_dir).run(("fista", "omp"))
    first = out["weights"].groupBy(*M).agg(F.min("rebal_dt").alias("first_dt"))
    nav = out["nav"].join(first, M)
    before = F.when(F.col("dt") < F.col("first_dt"), F.col("dt"))
    curve = nav.groupBy(*M).agg(F.count("nav").alias("n_dates"), F.min_by("nav", "dt").alias("first_nav"), F.max_by("nav", before).alias("opening_nav"))
    books = out["weights"].groupBy(*M, "rebal_dt").agg(((F.abs(F.sum("w") - 1) < 1e-9) & (F.min("w") >= 0)).alias("good"))
    return rounded(curve.join(books.groupBy(*M).agg(F.count(F.lit(1)).alias("n_books"), F.count_if("good").alias("n_on_simplex")), M), 4)


@query(
    """, mem AS (SELECT universe, CAST(date_trunc('week', d) AS DATE) AS dt, asset FROM ln GROUP BY ALL HAVING count(*) >= 2), listed AS (SELECT DISTINCT universe, dt FROM mem),
    mw AS (SELECT win.*, l.dt IS NULL OR m.asset IS NOT NULL AS active FROM win LEFT JOIN listed l ON l.universe = win.universe AND l.dt = win.rebal_dt LEFT JOIN mem m ON m.universe = win.universe AND m.dt = win.rebal_dt AND m.asset = win.asset),
    tops AS (SELECT universe, rebal_dt, asset FROM (SELECT universe, rebal_dt, asset, avg(CASE WHEN active THEN r ELSE 0 END) AS m FROM mw GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY universe, rebal_dt ORDER BY m DESC, asset) <= 10),
    act AS (SELECT DISTINCT universe, rebal_dt, asset FROM mw WHERE active), inside AS (SELECT * FROM tops SEMI JOIN act USING (universe, rebal_dt, asset)),
    books AS (SELECT * FROM inside UNION ALL SELECT * FROM act ANTI JOIN inside USING (universe, rebal_dt))
    SELECT universe, rebal_dt, asset, round(1.0 / count(*) OVER (PARTITION BY universe, rebal_dt), 8) AS w FROM books"""
)
def nav_membership(spark, sf_dir):
    """Books under a membership overlay: non-members' returns count as 0, and only members are held."""
    t = Tables(spark, sf_dir)
    r, members = table(t.weekly()), table(market.membership(t.totals("week"), 2))
    config = walkforward.Config(methods=("equal_mean",), lookback=LOOKBACK)
    return rounded(walkforward.target_weights(r, t.bench("week"), config, members=members).drop("method"), 8)


@query(
    """, steps AS (SELECT d.universe, d.method, d.dt, d.g, d.rebal_dt FROM daily d), prior AS (SELECT universe, method, rebal_dt, coalesce(product(g_all) OVER (PARTITION BY universe, method ORDER BY rebal_dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS p FROM whole),
    opened AS (SELECT universe, method, arg_max(nav, dt) AS opening FROM early GROUP BY ALL)
    SELECT universe, method, dt, round(nav, 4) AS nav FROM early UNION ALL SELECT s.universe, s.method, s.dt, round(opening * p * g, 4) FROM steps s JOIN prior USING (universe, method, rebal_dt) JOIN opened o ON o.universe = s.universe AND o.method = s.method"""
)
def nav_no_cost(spark, sf_dir):
    return rounded(Tables(spark, sf_dir).run(cost=accounting.no_cost())["nav"], 4)


@query("SELECT universe, dt, round(nav, 4) AS nav FROM bench")
def benchmark_method(spark, sf_dir):
    """The benchmark as a method of a run."""
    nav = Tables(spark, sf_dir).run(("equal_cap", "benchmark"))["nav"]
    return rounded(nav.filter("method = 'benchmark'").drop("method"), 4)


@query(
    """, e AS (SELECT universe, asset, row_number() OVER (PARTITION BY universe ORDER BY md5('0:' || asset), asset) AS rn FROM (SELECT DISTINCT universe, asset FROM ln))
    SELECT universe, asset, round(1.0 / count(*) OVER (PARTITION BY universe), 8) AS w FROM e WHERE rn <= 10"""
)
def random_n(spark, sf_dir):
    return rounded(rules.random_n(Tables(spark, sf_dir).lines.select("universe", "asset").distinct(), 10, ["universe"]), 8)


@query(
    """, s AS (SELECT universe, asset, cap / sum(cap) OVER (PARTITION BY universe) AS w FROM wm), k AS (SELECT * FROM s WHERE w >= 0.05)
    SELECT universe, asset, round(w / sum(w) OVER (PARTITION BY universe), 8) AS w FROM k UNION ALL SELECT universe, asset, round(1.0 / count(*) OVER (PARTITION BY universe), 8) FROM s WHERE universe NOT IN (SELECT universe FROM k)"""
)
def uniform_fallback(spark, sf_dir):
    """Universes where no weight reaches the threshold are uniform."""
    caps = table(Tables(spark, sf_dir).caps())
    share = rules.top_n_cap(caps, 10**6, ["universe"])
    return rounded(rules.to_simplex(share, ["universe"], 0.05, caps.select("universe", "asset")), 8)


@query(
    """, ranked AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY w DESC, asset) AS k FROM w10)
    SELECT universe, count(*) AS n_active, round(max(w), 8) AS w_max, array_to_string(list(k || ':' || asset ORDER BY k) FILTER (k <= 4), ',') AS names, round(sum(w * 100) FILTER (k <= 4), 6) AS pct FROM ranked GROUP BY universe"""
)
def portfolio_summary(spark, sf_dir):
    out = rules.summary(Tables(spark, sf_dir).top10(), ["universe"], 4)
    names = F.array_join(F.transform("top", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["asset"])), ",")
    pct = F.aggregate("top", F.lit(0.0), lambda acc, x: acc + x["pct"])
    return out.select("universe", "n_active", F.round("w_max", 8).alias("w_max"), names.alias("names"), F.round(pct, 6).alias("pct"))


# ---- risk ------------------------------------------------------------------------------------------


@query(
    """, pb AS (SELECT universe, split, dt, sum(w * r) AS p, any_value(y) AS b FROM tt JOIN w10 USING (universe, asset) GROUP BY ALL)
    SELECT universe, split, dt, round(product(1 + p) OVER (PARTITION BY universe ORDER BY dt ROWS UNBOUNDED PRECEDING), 6) AS portfolio, round(product(1 + b) OVER (PARTITION BY universe ORDER BY dt ROWS UNBOUNDED PRECEDING), 6) AS benchmark FROM pb"""
)
def chained_curve(spark, sf_dir):
    """Train and test as one line; the twin compounds straight over both."""
    t = Tables(spark, sf_dir)
    return rounded(accounting.chained(compare.split_curves(t.train_test(), t.top10(), []), ["universe"]))


@query("SELECT universe, method, round(avg(p - 1e-4) / stddev_samp(p - 1e-4) * sqrt(52), 6) AS sharpe, round(avg(p - 1e-4) / sqrt(avg(pow(least(p - 1e-4, 0), 2))) * sqrt(52), 6) AS sortino FROM cur GROUP BY ALL")
def risk_free_ratios(spark, sf_dir):
    return rounded(risk.risk_core(Tables(spark, sf_dir).curves(), M, YEAR["week"], rf=1e-4).select(*M, "sharpe", "sortino"))


_LAGGED = " + ".join(f"{2 * (1 - lag / 6)} * coalesce(sum(u{{k}} * l{{k}}_{lag}), 0)" for lag in range(1, 6))


@query(
    """, mo AS (SELECT universe, method, count(*) AS n, covar_pop(mkt_rf, mkt_rf) AS a, covar_pop(mkt_rf, smb) AS b, covar_pop(mkt_rf, hml) AS c, covar_pop(smb, smb) AS d, covar_pop(smb, hml) AS e, covar_pop(hml, hml) AS f,
      covar_pop(mkt_rf, y) AS u, covar_pop(smb, y) AS v, covar_pop(hml, y) AS x, avg(y) AS my, avg(mkt_rf) AS m1, avg(smb) AS m2, avg(hml) AS m3 FROM curf GROUP BY ALL),
    dt3 AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM mo),
    inv AS (SELECT *, (d * f - e * e) / det AS i11, (c * e - b * f) / det AS i12, (b * e - c * d) / det AS i13, (a * f - c * c) / det AS i22, (b * c - a * e) / det AS i23, (a * d - b * b) / det AS i33 FROM dt3),
    co AS (SELECT *, i11 * u + i12 * v + i13 * x AS b1, i12 * u + i22 * v + i23 * x AS b2, i13 * u + i23 * v + i33 * x AS b3 FROM inv), al AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM co),
    q AS (SELECT k.universe, k.method, k.dt, k.y - b0 - b1 * k.mkt_rf - b2 * k.smb - b3 * k.hml AS res, n, m1, m2, m3, (i11 * (mkt_rf - m1) + i12 * (smb - m2) + i13 * (hml - m3)) / n AS q1, (i12 * (mkt_rf - m1) + i22 * (smb - m2) + i23 * (hml - m3)) / n AS q2,
      (i13 * (mkt_rf - m1) + i23 * (smb - m2) + i33 * (hml - m3)) / n AS q3 FROM curf k JOIN al ON al.universe = k.universe AND al.method = k.method),
    s AS (SELECT universe, method, dt, (1.0 / n - m1 * q1 - m2 * q2 - m3 * q3) * res AS u0, q1 * res AS u1, q2 * res AS u2, q3 * res AS u3 FROM q),
    lagged AS (SELECT *, """
    + ", ".join(f"lag(u{k}, {lag}) OVER w AS l{k}_{lag}" for k in range(4) for lag in range(1, 6))
    + " FROM s WINDOW w AS (PARTITION BY universe, method ORDER BY dt)), var AS (SELECT universe, method, "
    + ", ".join(f"sum(u{k} * u{k}) + {_LAGGED.format(k=k)} AS v{k}" for k in range(4))
    + " FROM lagged GROUP BY ALL) SELECT universe, method, "
    + ", ".join(f"round(b{k} / sqrt(v{k}), 4) AS t_{name}" for k, name in enumerate(("alpha", *risk.FACTORS)))
    + " FROM var JOIN al USING (universe, method)"
)
def ff3_tstats(spark, sf_dir):
    """Autocorrelation-robust t statistics at five lags."""
    return rounded(risk.ff3_tstats(Tables(spark, sf_dir).with_factors(), M, 5), 4)


@query(
    """, y AS (SELECT universe, datediff('day', min(rebal_dt), max(rebal_dt)) / 365.25 AS years FROM sched GROUP BY universe)
    SELECT universe, method, round(avg(turnover), 8) AS turnover_avg, round(quantile_cont(turnover, 0.95), 8) AS turnover_p95, count(*) AS n_rebalances, round(sum(turnover) / any_value(years), 8) AS turnover_annual FROM turn JOIN y USING (universe) GROUP BY ALL"""
)
def turnover_stats(spark, sf_dir):
    """Annual turnover over the span of all rebalance dates, those without enough history included."""
    t = Tables(spark, sf_dir)
    plan = schedule.monthly(t.weekly()).withColumnRenamed("rebal_dt", "dt")
    return rounded(risk.turnover_stats(t.run()["rebalances"], schedule.span_years(plan, ["universe"]), M), 8)
