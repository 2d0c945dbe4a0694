"""Head-to-heads, sweeps and regimes of all methods, rules and fits, on training dates alone, with twins that solve the same problems in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import compare, moments, risk, rules
from ..session import table
from .fitted import _HELD_OUT, _L1, _REGIME_DATA, _TRAIN_CAPS, _shown, descent, greedy_steps, reweighting_steps
from .queries import _FIT_METHODS, YEAR, Tables, _all_holdout, _all_methods, _on_test, _regime_split, _train_caps, query, rounded


def solved(fractions: tuple[float, ...], k: int, source: str, stats: str, sweeps: int = 1500, methods: tuple[str, ...] = _FIT_METHODS) -> str:
    """CTEs up to ``money``: universe, method, lam_idx, asset, w in money, of all fits on ``source``; the greedy fit has a row set for each of its sizes, as lam_idx."""
    own = [m for m in methods if m in _L1]
    sql = descent(fractions, source, sweeps)
    parts = [f"SELECT m AS method, universe, lam_idx, asset, w[i] AS v FROM path JOIN pa USING (universe), (SELECT unnest({own}) AS m) WHERE w[i] > 1e-9"]
    if "omp" in methods:
        sql += greedy_steps(k)
        parts.append("SELECT 'omp', universe, CAST(iter AS INT), asset, w[i] FROM picks JOIN pa USING (universe) WHERE w[i] > 1e-12")
    for name, method, relative in (("ra", "reweighted", False), ("rb", "reweighted_relative", True)):
        if method in methods:
            sql += reweighting_steps(fractions, sweeps // 3, relative, name)
            parts.append(f"SELECT '{method}', universe, lam_idx, asset, w[i] FROM {name}_last JOIN pa USING (universe) WHERE w[i] > 1e-9")
    return (
        sql
        + f""", every_fit AS ({" UNION ALL ".join(parts)}
), raw AS (SELECT universe, method, lam_idx, asset, v / CASE WHEN sigma > 1e-12 THEN sigma ELSE 1 END AS v FROM every_fit JOIN {stats} s USING (universe, asset)
), share AS (SELECT *, v / sum(v) OVER (PARTITION BY universe, method, lam_idx) AS s FROM raw
), money AS MATERIALIZED (SELECT universe, method, lam_idx, asset, s / sum(s) OVER (PARTITION BY universe, method, lam_idx) AS w FROM share WHERE s >= 1e-4) """
    )


#: Each method's first step of the ladder with weights, and of the greedy fit the last one.
_FIRST = """, first2 AS (SELECT universe, method, CASE WHEN method = 'omp' THEN max(lam_idx) ELSE min(lam_idx) END AS lam_idx FROM money GROUP BY universe, method), chosen AS (SELECT money.* FROM money JOIN first2 USING (universe, method, lam_idx))"""
_RULES = """SELECT universe, 'cap' AS method, asset, cap / sum(cap) OVER (PARTITION BY universe) AS w FROM trank WHERE rn <= 10 UNION ALL SELECT universe, 'equal', asset, 1.0 / count(*) OVER (PARTITION BY universe) FROM trank WHERE rn <= 10 UNION ALL SELECT universe, 'random', asset, w FROM rmean"""
_ALL = solved(compare.LADDER, 10, "xm", "st") + _FIRST + _TRAIN_CAPS + f", allw2 AS (SELECT universe, method, 0 AS step, asset, w FROM (SELECT universe, method, asset, w FROM chosen UNION ALL {_RULES}))" + _HELD_OUT
_METRICS = "round(r2, 4) AS r2, round(te, 6) AS te, round(ir, 5) AS ir, round(sharpe, 5) AS sharpe"


@query(_ALL + f"SELECT universe, method, n_active, {_METRICS} FROM final2")
def method_comparison_all(spark, sf_dir):
    """Three rules and six fits on one split, scored on its test dates."""
    return _shown(_all_holdout(Tables(spark, sf_dir)).drop("rss"))


@query(_ALL + f"SELECT u.universe, method, n_active, {_METRICS}, CASE WHEN n_active IS NULL THEN 'no weights' END AS error FROM (SELECT r_name AS universe FROM region UNION ALL SELECT 'nowhere') u LEFT JOIN final2 f ON f.universe = u.universe")
def multi_universe_all(spark, sf_dir):
    """Every universe and method; a universe without a fit stays as a row with a reason."""
    t = Tables(spark, sf_dir)
    universes = t.read("region").select(F.col("r_name").alias("universe")).unionByName(spark.range(1).select(F.lit("nowhere").alias("universe")))
    return _shown(compare.with_failures(universes, _all_holdout(t).drop("rss"), F.lit("no weights")))


_SIZES = (3, 5, 8, 12)
_SWEEP = (
    solved(moments.FRACTIONS, 12, "xm", "st", methods=("fista", "omp", "reweighted", "reweighted_relative"))
    + _TRAIN_CAPS
    + f""", sizes AS (SELECT unnest({[*_SIZES]}) AS k), reached AS (SELECT universe, k, max(lam_idx) AS lam_idx FROM money, sizes WHERE method = 'omp' AND lam_idx <= k GROUP BY ALL), allw2 AS (
  SELECT universe, method, lam_idx AS step, asset, w FROM money WHERE method <> 'omp' UNION ALL SELECT m.universe, 'omp', k, asset, w FROM money m JOIN reached USING (universe, lam_idx) WHERE method = 'omp'
  UNION ALL SELECT universe, 'cap', k, asset, cap / sum(cap) OVER (PARTITION BY universe, k) FROM trank, sizes WHERE rn <= k UNION ALL SELECT universe, 'equal', k, asset, 1.0 / count(*) OVER (PARTITION BY universe, k) FROM trank, sizes WHERE rn <= k)"""
    + _HELD_OUT
)


@query(_SWEEP + "SELECT universe, method, step, n_active, round(te, 6) AS te, round(r2, 4) AS r2, coalesce(round(te, 9) < min(round(te, 9)) OVER (PARTITION BY universe, method ORDER BY n_active, round(te, 9), step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS efficient FROM final2")
def pareto_all(spark, sf_dir):
    """The sweep of every method: names of rules and greedy fits, penalties of the others. ``step`` is N or the penalty's number."""
    t = Tables(spark, sf_dir)
    rows = table(t.train_test())
    caps = table(_train_caps(rows, t.prices("month").drop("price")))
    _, path = compare.split_fit(rows, ("fista", "reweighted", "reweighted_relative"), moments.FRACTIONS)
    sweep = path.withColumnRenamed("lam_idx", "step")
    for n in _SIZES:
        _, greedy = compare.split_fit(rows, ("omp",), (), n)
        both = compare.compare({"cap": rules.top_n_cap(caps, n, ["universe"]), "equal": rules.equal_top_n_cap(caps, n, ["universe"]), "omp": greedy.drop("method", "lam_idx")})
        sweep = sweep.unionByName(both.withColumn("step", F.lit(n)))
    by = Window.partitionBy("universe", "method").orderBy("n_active", "te", "step").rowsBetween(Window.unboundedPreceding, -1)
    m = _on_test(rows, table(sweep), ["method", "step"]).select("universe", "method", "step", "n_active", F.round("te", 9).alias("te"), "r2")
    return _shown(m.withColumn("efficient", F.coalesce(F.col("te") < F.min("te").over(by), F.lit(True))))


# ---- regimes ---------------------------------------------------------------------------------------


def _regime_fits(t: Tables, methods: tuple[str, ...] = _FIT_METHODS) -> DataFrame:
    rows = _regime_split(t)
    dates = rows.select("universe", F.split("universe", "[|]")[0].alias("u"), "dt").distinct()
    caps = t.prices("week").select(F.col("universe").alias("u"), "dt", "asset", "cap").join(dates, ["u", "dt"]).drop("u")
    w = _all_methods(rows.drop("type"), caps, methods)
    curves = table(compare.split_curves(rows, w, ["method"]))
    by = ["universe", "method"]
    scored = compare.in_vs_out(curves, by, YEAR["week"])
    test = curves.filter("split = 'test'")
    gap = test.groupBy(*by).agg((F.max(F.abs(F.col("p") - F.col("b"))) * 100).alias("max_gap_pct"))
    gaps = gap.join(risk.max_cumulative_gap(test, by), by)
    size = w.groupBy(*by).agg(F.count(F.when(F.col("w") > 1e-6, 1)).alias("n_active"))
    ranked = w.withColumn("w", F.round("w", 9))  # equal weights are ties, whatever order they were summed in
    top = compare.top_holdings(ranked, by, 3).select(*by, F.array_join(F.transform("top", lambda x: x["asset"]), ",").alias("top"))
    out = scored.join(gaps, by).join(size, by).join(top, by).join(rows.select("universe", "type").distinct(), "universe")
    out = compare.regime_verdict(out.withColumns({"r2": F.col("r2_test"), "te_pct": F.col("te_test")})).drop("r2_test", "te_test")
    parts = F.split("universe", "[|]")
    return out.withColumns({"regime": parts[1], "universe": parts[0]})


_REPORT = (
    _REGIME_DATA
    + solved(compare.LADDER, 10, "rx", "rst", 2500, ("admm", "omp"))
    + _FIRST
    + _TRAIN_CAPS.replace("FROM tt JOIN pm USING (universe, dt, asset) WHERE split = 'train'", "FROM rsplit s JOIN (SELECT universe AS u, dt AS d, asset AS a, cap FROM pw) ON u = split_part(universe, '|', 1) AND d = dt AND a = asset WHERE split = 'train'")
    + f""", rw2 AS MATERIALIZED (SELECT universe, method, asset, w FROM chosen UNION ALL {_RULES}
), rp AS MATERIALIZED (SELECT universe, method, any_value(type) AS type, split, dt, sum(w * r) AS p, any_value(y) AS b FROM rsplit JOIN rw2 USING (universe, asset) GROUP BY universe, method, split, dt
), rq AS (SELECT universe, method, any_value(type) AS type, 1 - sum((b - p) * (b - p)) FILTER (split = 'test') / (var_pop(b) FILTER (split = 'test') * count(*) FILTER (split = 'test')) AS r2, stddev_pop(p - b) FILTER (split = 'test') * sqrt(52) * 100 AS te,
    1 - sum((b - p) * (b - p)) FILTER (split = 'train') / (var_pop(b) FILTER (split = 'train') * count(*) FILTER (split = 'train')) AS r2_train, max(abs(p - b)) FILTER (split = 'test') * 100 AS gap FROM rp GROUP BY universe, method
), rg AS (SELECT universe, method, max(abs(cp - cb)) AS cgap FROM (SELECT universe, method, product(1 + p) OVER v AS cp, product(1 + b) OVER v AS cb FROM rp WHERE split = 'test' WINDOW v AS (PARTITION BY universe, method ORDER BY dt ROWS UNBOUNDED PRECEDING)) GROUP BY ALL
), rn2 AS (SELECT universe, method, count(*) FILTER (w > 1e-6) AS n_active FROM rw2 GROUP BY ALL
), rt AS (SELECT universe, method, string_agg(asset, ',' ORDER BY k) AS top FROM (SELECT *, row_number() OVER (PARTITION BY universe, method ORDER BY round(w, 9) DESC, asset) AS k FROM rw2) WHERE k <= 3 GROUP BY ALL) """
)


@query(
    _REPORT
    + """SELECT split_part(universe, '|', 1) AS universe, split_part(universe, '|', 2) AS regime, method, type, n_active, round(r2, 3) AS r2, round(r2_train, 3) AS r2_train, round(te, 4) AS te_pct, round(gap, 4) AS max_gap_pct, round(cgap, 5) AS max_cumulative_gap, top, coalesce(r2 > 0.5 AND te < 15, false) AS passed
    FROM rq JOIN rg USING (universe, method) JOIN rn2 USING (universe, method) JOIN rt USING (universe, method)"""
)
def regime_report(spark, sf_dir):
    """Per universe, regime and method: the penalized fit at its own step of the ladder, the greedy fit and three rules, with gaps, top names and the verdict."""
    out = _regime_fits(Tables(spark, sf_dir), ("admm", "omp"))
    digits = {"r2": 3, "r2_train": 3, "te_pct": 4, "max_gap_pct": 4, "max_cumulative_gap": 5}
    return out.select("universe", "regime", "method", "type", "n_active", "top", "passed", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query()
def regime_fits(spark, sf_dir):
    """Per universe, regime and method: split, fit (first penalty of the ladder with weights), train and test metrics, top names."""
    return rounded(_regime_fits(Tables(spark, sf_dir)), 5)


@query(_REPORT + "SELECT method, type, count(*) AS n, round(avg(r2), 3) AS r2_avg, round(avg(te), 3) AS te_avg, bool_and(coalesce(r2 > 0.5 AND te < 15, false)) AS all_passed FROM rq GROUP BY ALL")
def regime_report_type_avg(spark, sf_dir):
    """The same by method and kind of regime."""
    found = table(_regime_fits(Tables(spark, sf_dir), ("admm", "omp")))
    return rounded(found.groupBy("method", "type").agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("r2_avg"), F.avg("te_pct").alias("te_avg"), F.bool_and("passed").alias("all_passed")), 3)


@query()
def regime_fits_type_avg(spark, sf_dir):
    found = table(_regime_fits(Tables(spark, sf_dir)))
    return rounded(found.groupBy("method", "type").agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("r2_avg"), F.avg("te_pct").alias("te_avg"), F.bool_and("passed").alias("all_passed")), 4)
