"""Risk, tracking and factor metrics. Undefined values are null.

``curves`` has the columns of ``by``, dt, p and b (portfolio and benchmark returns); most metrics are one grouped aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, table

DAYS = 252


def curve_returns(nav: DataFrame, benchmark: DataFrame, by: list[str]) -> DataFrame:
    """Returns of ``nav`` (by, dt, nav) and ``benchmark`` (universe, dt, nav) on their common dates; the first date is lost."""
    both = nav.join(benchmark.select("universe", "dt", F.col("nav").alias("bench")), ["universe", "dt"])
    order = Window.partitionBy(*by).orderBy("dt")
    out = both.withColumns({"p": F.col("nav") / F.lag("nav").over(order) - 1, "b": F.col("bench") / F.lag("bench").over(order) - 1})
    return out.filter("p is not null and b is not null").select(*by, "dt", "p", "b")


def annual_return(r: Column, days: float = DAYS) -> Column:
    total = F.product(1 + r)
    return F.when(total > 0, F.pow(total, F.lit(days) / F.count(r)) - 1)


def volatility(r: Column, days: float = DAYS) -> Column:
    return F.when(F.count(r) >= 2, F.stddev_samp(r) * F.sqrt(F.lit(days)))


def sharpe(r: Column, days: float = DAYS, rf: Column | float = 0.0) -> Column:
    """Of returns in excess of ``rf``, a rate per period or a column of rates."""
    r = r - rf
    s = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (s * F.sqrt(F.lit(days)) >= 1e-12), F.avg(r) / s * F.sqrt(F.lit(days)))


def sortino(r: Column, days: float = DAYS, rf: Column | float = 0.0) -> Column:
    r = r - rf
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))
    return F.when((F.count(r) >= 2) & (down >= 1e-12), F.avg(r) / down * F.sqrt(F.lit(days)))


def information_ratio(p: Column, b: Column, days: float = DAYS) -> Column:
    return sharpe(p - b, days)


def risk_core(curves: DataFrame, by: list[str], days: float = DAYS, rf: Column | float = 0.0) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, tracking error, information ratio and the benchmark's own, in one pass. ``rf``: the cash rate per period."""
    p, b = F.col("p"), F.col("b")
    return curves.groupBy(*by).agg(
        F.count(p).alias("n"),
        annual_return(p, days).alias("ann_return"),
        volatility(p, days).alias("ann_vol"),
        sharpe(p, days, rf).alias("sharpe"),
        sortino(p, days, rf).alias("sortino"),
        volatility(p - b, days).alias("tracking_error"),
        information_ratio(p, b, days).alias("information_ratio"),
        annual_return(b, days).alias("bench_return"),
        volatility(b, days).alias("bench_vol"),
    )


def capm(curves: DataFrame, by: list[str], days: float = DAYS, rf: float = 0.0) -> DataFrame:
    """Daily and annual alpha, beta and R2 of p - rf on b - rf; null below 3 rows or for a flat series."""
    p, b = F.col("p") - rf, F.col("b") - rf
    good = (F.count(p) >= 3) & (F.stddev_samp(b) >= 1e-12) & (F.stddev_samp(p) >= 1e-12)
    out = curves.groupBy(*by).agg(F.when(good, F.regr_intercept(p, b)).alias("alpha_daily"), F.when(good, F.regr_slope(p, b)).alias("beta"), F.when(good, F.regr_r2(p, b)).alias("r2"), F.count(p).alias("n"))
    return out.withColumn("alpha", F.when(F.abs("alpha_daily") < 1, F.pow(1 + F.col("alpha_daily"), days) - 1))


def drawdowns(nav: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return nav.withColumn("dd", F.col("nav") / F.max("nav").over(order) - 1).select(*by, "dt", "dd")


def drawdown_stats(nav: DataFrame, by: list[str]) -> DataFrame:
    """Maximum drawdown and ulcer index."""
    return drawdowns(nav, by).groupBy(*by).agg(F.min("dd").alias("max_drawdown"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("ulcer"))


def calmar(core: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    return core.join(stats, by).select(*by, F.when(F.abs("max_drawdown") >= 1e-12, F.col("ann_return") / F.abs("max_drawdown")).alias("calmar"))


# ---- three factors ---------------------------------------------------------------------------------

FACTORS = ["mkt_rf", "smb", "hml"]


def _solve3(m: list[list[Column]], v: list[Column]) -> tuple[list[Column], Column]:
    """Cramer's rule: the solution's numerators and the determinant."""

    def det(a):
        return (
            a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
            - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
            + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
        )

    tops = [det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    return tops, det(m)


def ff3(curves: DataFrame, by: list[str], days: float = DAYS) -> DataFrame:
    """Three-factor OLS of p - rf; null below 5 rows. ``curves`` holds the factors and rf on the same dates."""
    # moments first, then the solution on one row per group
    y = F.col("p") - F.col("rf")
    f = [F.col(c) for c in FACTORS]
    names = {f"_c{i}{j}": F.covar_pop(f[i], f[j]) for i in range(3) for j in range(i, 3)} | {f"_v{i}": F.covar_pop(f[i], y) for i in range(3)} | {f"_m{i}": F.avg(f[i]) for i in range(3)}
    rows = curves.groupBy(*by).agg(*[c.alias(n) for n, c in names.items()], F.avg(y).alias("_y"), F.var_pop(y).alias("_var"), F.count(y).alias("n"))
    m = [[F.col(f"_c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    v = [F.col(f"_v{i}") for i in range(3)]
    tops, det = _solve3(m, v)
    good = (F.col("n") >= 5) & (F.abs(det) > 1e-30)
    beta = [F.when(good, t / det) for t in tops]
    rows = rows.withColumns({f"beta_{n}": b for n, b in zip(FACTORS, beta, strict=True)})
    b = [F.col(f"beta_{n}") for n in FACTORS]
    alpha = F.col("_y") - b[0] * F.col("_m0") - b[1] * F.col("_m1") - b[2] * F.col("_m2")
    r2 = F.when(F.col("_var") > 1e-20, (b[0] * v[0] + b[1] * v[1] + b[2] * v[2]) / F.col("_var"))
    return rows.select(*by, (F.pow(1 + alpha, days) - 1).alias("alpha"), *[f"beta_{n}" for n in FACTORS], r2.alias("r2"), "n")


def ff3_rolling(curves: DataFrame, by: list[str], window: int = 90) -> DataFrame:
    """Betas over the last ``window`` rows; null before there are as many, or where the factors depend on each other.

    A window's moments are differences of running sums, so a row costs the same for any ``window``. Values are centred on their group's mean first, so that sums stay small
    against what they differ by. A row with a missing value has no place in the windows and no betas.
    """
    names = [*FACTORS, "y"]
    rows = curves.withColumn("y", F.col("p") - F.col("rf")).select(*by, "dt", *names).dropna(subset=names)
    means = rows.groupBy(*by).agg(*[F.avg(n).alias(f"_a_{n}") for n in names])
    centred = rows.join(means, by).select(*by, "dt", *[(F.col(n) - F.col(f"_a_{n}")).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:] if (a, b) != ("y", "y")]
    order = Window.partitionBy(*by).orderBy("dt")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_s_{n}": F.sum(n).over(so_far) for n in names} | {f"_s_{a}_{b}": F.sum(F.col(a) * F.col(b)).over(so_far) for a, b in pairs}
    running = centred.select(*by, "dt", F.row_number().over(order).alias("_n"), *[c.alias(n) for n, c in sums.items()])
    moved = running.select(*by, "dt", "_n", *[(F.col(n) - F.coalesce(F.lag(n, window).over(order), F.lit(0.0))).alias(n) for n in sums])
    cov = lambda a, b: F.col(f"_s_{a}_{b}") / window - F.col(f"_s_{a}") * F.col(f"_s_{b}") / window**2
    moments = {f"_c{i}{j}": cov(FACTORS[i], FACTORS[j]) for i in range(3) for j in range(i, 3)} | {f"_v{i}": cov(FACTORS[i], "y") for i in range(3)}
    made = moved.select(*by, "dt", "_n", *[c.alias(n) for n, c in moments.items()])
    tops, det = _solve3([[F.col(f"_c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)], [F.col(f"_v{i}") for i in range(3)])
    good = (F.col("_n") >= window) & (F.abs(det) > 1e-30)
    betas = made.select(*by, "dt", *[F.when(good, t / det).alias(f"beta_{n}") for n, t in zip(FACTORS, tops, strict=True)])
    return curves.select(*by, "dt").join(betas, [*by, "dt"], "left")


def newey_west(x: np.ndarray, y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """OLS coefficients and t statistics with Bartlett weights and no small-sample correction."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ (x.T @ y)
    s = x * (y - x @ beta)[:, None]
    meat = s.T @ s
    for lag in range(1, min(lags, len(s) - 1) + 1):
        g = s[lag:].T @ s[:-lag]
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    return beta, beta / np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 1e-300))


def ff3_tstats(curves: DataFrame, by: list[str], lags: int = 5) -> DataFrame:
    """t statistics of alpha and betas, autocorrelation-robust; groups below 5 rows have none."""
    ship(curves.sparkSession)
    names = ["t_alpha", *[f"t_{n}" for n in FACTORS]]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        head = rows[by].iloc[:1].reset_index(drop=True)
        if len(rows) < 5:
            return head.assign(**{n: None for n in names})
        x = np.column_stack([np.ones(len(rows)), rows[FACTORS].to_numpy(dtype=float)])
        _, t = newey_west(x, (rows["p"] - rows["rf"]).to_numpy(dtype=float), lags)
        return head.assign(**dict(zip(names, t, strict=True)))

    kinds = dict(curves.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], *[f"{n} double" for n in names]])
    return curves.select(*by, "dt", "p", "rf", *FACTORS).groupBy(*by).applyInPandas(run, schema)


# ---- turnover and concentration --------------------------------------------------------------------


def quantile(rows: DataFrame, by: list[str], value: str, q: float, name: str, bins: int = 1024, most: int = 10000) -> DataFrame:
    """(by, name): the exact ``q`` quantile of a group's values, interpolated between its two neighbours in rank. Nulls, NaN and infinities are no values.

    Counts in ranges, which merge before they are shuffled: each pass counts the values of the range that holds a wanted rank in ``bins`` parts and goes on with one part, until that holds
    ``most`` values or all of it are equal. So no group's values ever meet, whatever their number, skew or ties; a pass narrows a range about ``bins`` times.
    """
    values = rows.select(*by, F.col(value).cast("double").alias("v")).filter("abs(v) < double('Infinity')")
    place = (F.col("n") - 1) * F.lit(float(q))
    spans = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    zero = F.lit(0).cast("long")
    wanted = table(spans.select(*by, "n", F.explode(ranks).alias("k"), "lo", "hi", zero.alias("below"), F.col("n").alias("held")))
    inside = lambda t: values.join(t.select(*by, "k", "lo", "hi", "below"), by).filter("v >= lo and v <= hi")
    while not wanted.filter((F.col("held") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = inside(wanted.filter("lo < hi")).groupBy(*by, "k", "below", part.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        order = Window.partitionBy(*by, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
        found = counts.withColumn("upto", F.col("below") + F.sum("c").over(order)).filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k")))
        found = found.select(*by, "k", "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("held"))
        wanted = table(wanted.filter("lo = hi").unionByName(found.join(wanted.select(*by, "k", "n"), [*by, "k"]).select(*wanted.columns)))
    few = inside(wanted.filter("lo < hi")).groupBy(*by, "k").agg(F.get(F.sort_array(F.collect_list("v")), (F.first("k") - F.first("below")).cast("int")).alias("v"))
    at = wanted.filter("lo = hi").select(*by, "k", F.col("lo").alias("v")).unionByName(few)
    share = F.first("n") - 1
    ends = at.join(wanted.select(*by, "k", "n"), [*by, "k"]).groupBy(*by).agg(F.min_by("v", "k").alias("a"), F.max_by("v", "k").alias("b"), (share * F.lit(float(q)) - F.floor(share * F.lit(float(q)))).alias("part"))
    return ends.select(*by, (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias(name))


def turnover_stats(rebalances: DataFrame, years: DataFrame, by: list[str]) -> DataFrame:
    """Mean, 95th percentile, count and annual sum of turnover. ``years``: columns of ``by``, years; the span of the rebalance dates, skipped ones included."""
    out = rebalances.groupBy(*by).agg(
        F.avg("turnover").alias("turnover_avg"), F.count(F.lit(1)).alias("n_rebalances"), F.sum("turnover").alias("_sum")
    )
    out = out.join(quantile(rebalances, by, "turnover", 0.95, "turnover_p95"), by, "left")
    return out.join(years, [c for c in by if c in years.columns], "left").withColumn("turnover_annual", F.col("_sum") / F.col("years")).drop("_sum", "years")


def concentration(weights: DataFrame, by: list[str]) -> DataFrame:
    """Herfindahl index and largest weight over the rebalances; the effective number is one over the mean index."""
    each = weights.groupBy(*by, "rebal_dt").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), F.max("w").alias("top"))
    high = quantile(each, by, "hhi", 0.95, "hhi_p95")
    return each.groupBy(*by).agg(
        F.avg("hhi").alias("hhi_avg"), F.avg("top").alias("max_weight_avg"), F.max("top").alias("max_weight"), (1.0 / F.avg("hhi")).alias("effective_n_avg")
    ).join(high, by, "left")


# ---- fit quality -----------------------------------------------------------------------------------


def r_squared(p: Column, b: Column) -> Column:
    """1 - RSS / TSS of the benchmark explained by the portfolio; null for a flat benchmark."""
    tss = F.var_pop(b) * F.count(b)
    return F.when(tss >= 1e-30, 1 - F.sum((b - p) * (b - p)) / tss)


def tracking_percent(curves: DataFrame, by: list[str], days: float = DAYS) -> DataFrame:
    """Tracking error in percent (population), correlation, largest daily gap, total returns and R2."""
    p, b = F.col("p"), F.col("b")
    return curves.groupBy(*by).agg(
        (F.stddev_pop(p - b) * F.sqrt(F.lit(days)) * 100).alias("te_pct"),
        F.when((F.var_pop(p) > 1e-20) & (F.var_pop(b) > 1e-20), F.corr(p, b)).alias("correlation"),
        (F.max(F.abs(p - b)) * 100).alias("max_daily_gap_pct"),
        ((F.product(1 + p) - 1) * 100).alias("total_pct"),
        ((F.product(1 + b) - 1) * 100).alias("bench_total_pct"),
        r_squared(p, b).alias("r2"),
    )


def max_cumulative_gap(curves: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.product(1 + F.col("p")).over(order) - F.product(1 + F.col("b")).over(order))
    return curves.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("max_cumulative_gap"))
