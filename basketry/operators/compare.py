"""Comparisons, sweeps and roll-ups over universes, methods and regimes: all are columns of one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from . import fit, panel, risk, rules
from .panel import portfolio_returns

#: Penalties tried one after the other where a fit has no weight.
LADDER = (0.05, 0.03, 0.02, 0.01)
SPLIT_FIT = ["universe", "method", "lam_idx"]


def holdout_metrics(weights: DataFrame, returns: DataFrame, benchmark: DataFrame, by: list[str], days: float = risk.DAYS) -> DataFrame:
    """Fit quality of ``weights`` (universe, by, asset, w) on ``returns``; ratios that are undefined are 0 here, R2 is null."""
    p = portfolio_returns(returns, weights, by).withColumnRenamed("r", "p")
    both = p.join(benchmark.select("universe", "dt", F.col("r").alias("b")), ["universe", "dt"])
    zero = F.lit(0.0)
    x, b = F.col("p"), F.col("b")
    out = both.groupBy("universe", *by).agg(
        risk.r_squared(x, b).alias("r2"),
        F.coalesce(risk.volatility(x - b, days), zero).alias("te"),
        F.coalesce(risk.information_ratio(x, b, days), zero).alias("ir"),
        F.coalesce(risk.sharpe(x, days), zero).alias("sharpe"),
        F.sum((b - x) * (b - x)).alias("rss"),
    )
    size = weights.groupBy("universe", *by).agg(F.count(F.when(F.col("w") > 1e-6, 1)).alias("n_active"))
    return out.join(size, ["universe", *by])


def split_fit(rows: DataFrame, methods: tuple[str, ...], fractions: tuple[float, ...], cardinality: int = 10) -> tuple[DataFrame, DataFrame]:
    """(fits, weights by SPLIT_FIT) from the train rows of ``rows`` (universe, dt, asset, r, y, split) alone; weights are on the simplex."""
    on = F.col("split") == "train"
    x = table(panel.standardize(panel.varying_assets(rows, where=on), True, where=on).filter(on))
    fits = table(fit.fit_windows(x, methods, fractions, cardinality=cardinality, by=["universe"]))
    w = rules.destandardize(fit.fit_weights(fits, SPLIT_FIT), x.select("universe", "asset", "sigma").distinct(), SPLIT_FIT)
    return fits, table(w)


def ladder_fit(rows: DataFrame, methods: tuple[str, ...], ladder: tuple[float, ...] = LADDER, cardinality: int = 10) -> tuple[DataFrame, DataFrame]:
    """As :func:`split_fit`, but each method's first step of ``ladder`` with weights only; those without any are dropped."""
    fits, w = split_fit(rows, methods, ladder, cardinality)
    first = table(fit.first_nonempty(fits.join(w, SPLIT_FIT, "left_semi"), ["universe", "method"], ladder))
    return first, w.join(first, SPLIT_FIT, "left_semi").select("universe", "method", "asset", "w")


def split_curves(rows: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(universe, by, split, dt, p, b): the returns of ``weights`` and the benchmark on all dates of the split."""
    return rows.join(weights, ["universe", "asset"]).groupBy("universe", *by, "split", "dt").agg(F.sum(F.col("w") * F.col("r")).alias("p"), F.first("y").alias("b"))


def compare(tables: dict[str, DataFrame], include: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """The weight tables of several methods as one, with a method column; methods without rows are left out by themselves."""
    names = [n for n in (include or tables) if n in tables and n not in skip]
    out = None
    for n in names:
        one = tables[n].withColumn("method", F.lit(n))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no method is left")
    return out


def pareto(metrics: DataFrame, tie: str = "te") -> DataFrame:
    """Metrics of a sweep with its efficient points marked: no other point of the universe has as few names and a lower error. Of points that are equal in both, the first by ``tie`` counts."""
    by = Window.partitionBy("universe").orderBy("n_active", "te", tie).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("te").over(by)
    return metrics.withColumn("efficient", best.isNull() | (F.col("te") < best))


def with_failures(universes: DataFrame, results: DataFrame, reason: Column) -> DataFrame:
    """All universes: those without a result stay as a row with a reason."""
    return universes.join(results, "universe", "left").withColumn("error", F.when(F.col("n_active").isNull(), reason))


def headline(results: DataFrame, method: str, columns: list[str]) -> DataFrame:
    return results.filter(F.col("method") == method).select("universe", *columns)


def regime_verdict(metrics: DataFrame, least_r2: float = 0.5, most_te: float = 15.0) -> DataFrame:
    return metrics.withColumn("passed", F.coalesce((F.col("r2") > least_r2) & (F.col("te_pct") < most_te), F.lit(False)))


def type_averages(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("r2_avg"), F.avg("te_pct").alias("te_avg"), F.bool_and("passed").alias("all_passed"))


def top_holdings(weights: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """by, top: the ``k`` largest holdings as an array of (asset, w) in order."""
    order = Window.partitionBy(*by).orderBy(F.col("w").desc(), "asset")
    top = weights.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    packed = F.sort_array(F.collect_list(F.struct("rn", "asset", "w")))
    return top.groupBy(*by).agg(F.transform(packed, lambda x: F.struct(x["asset"].alias("asset"), x["w"].alias("w"))).alias("top"))


def timing_rollup(runs: DataFrame) -> DataFrame:
    """(method, p, seconds) -> mean and population deviation."""
    return runs.groupBy("method", "p").agg(F.avg("seconds").alias("mean_s"), F.stddev_pop("seconds").alias("std_s"), F.count(F.lit(1)).alias("n"))


def speedups(rollup: DataFrame, base: str, others: list[str]) -> DataFrame:
    """One row per p: every method's mean, and how many times faster than ``base`` each other one is."""
    wide = rollup.groupBy("p").pivot("method", [base, *others]).agg(F.first("mean_s"))
    return wide.withColumns({f"{m}_speedup": F.try_divide(F.col(base), F.col(m)) for m in others})


def in_vs_out(curves: DataFrame, by: list[str], days: float = risk.DAYS) -> DataFrame:
    """One row per group with train and test metrics. ``curves`` has split, p and b."""
    out = []
    for s in ("train", "test"):
        p, b = F.when(F.col("split") == s, F.col("p")), F.when(F.col("split") == s, F.col("b"))
        out += [risk.r_squared(p, b).alias(f"r2_{s}"), (F.stddev_pop(p - b) * F.sqrt(F.lit(days)) * 100).alias(f"te_{s}"), F.corr(p, b).alias(f"corr_{s}"), F.count(p).alias(f"n_{s}")]
    return curves.groupBy(*by).agg(*out)
