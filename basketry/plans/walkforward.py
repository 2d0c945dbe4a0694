"""The walk-forward back-test as one plan: windows -> weights of every method -> NAV, rebalances -> metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import accounting, fit, moments, panel, rules, schedule
from ..session import table


@dataclass(frozen=True)
class Config:
    """Parameters of a run. ``frequency`` is weekly or monthly; methods are rules, ``benchmark``, or solvers of the registry, those of the user included; ``cost`` is a cost model of the registry."""

    methods: tuple[str, ...] = ("equal_mean", "benchmark")
    frequency: str = "monthly"
    lookback: int = 26
    k: int = 10
    lam_frac: float = 0.05
    threshold: float = 1e-4
    capital: float = 1e6
    start: str | None = None
    end: str | None = None
    cost: str = "linear"
    cost_parameters: tuple[tuple[str, float], ...] = (("bps", 5.0),)

    def __post_init__(self):
        unknown = set(self.methods) - {*registry.RULES, *registry.solvers()}
        if unknown or not self.methods:
            raise ValueError(f"unknown methods: {sorted(unknown)}")
        if self.frequency not in ("weekly", "monthly") or self.lookback < 2 or self.k < 1:
            raise ValueError("frequency, lookback or k is out of range")


def target_weights(returns: DataFrame, benchmark: DataFrame, config: Config, caps: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(universe, method, rebal_dt, asset, w) of every method but ``benchmark``. ``caps``: universe, dt, asset, cap."""
    plan = schedule.weekly(returns) if config.frequency == "weekly" else schedule.monthly(returns)
    plan = plan.join(panel.clip_dates(plan.withColumnRenamed("rebal_dt", "dt"), config.start, config.end).select("universe", F.col("dt").alias("rebal_dt")), ["universe", "rebal_dt"], "left_semi")
    fitted = tuple(m for m in config.methods if m not in registry.RULES)
    by, tables = moments.WINDOW, []
    windows = schedule.train_windows(returns, plan, config.lookback)
    if members is not None:
        windows = schedule.masked(windows, members)
    assets = windows.select(*by, "asset").distinct()
    cap = None
    if caps is not None:
        cap = windows.select(*by, "dt", "asset").join(caps, ["universe", "dt", "asset"]).groupBy(*by, "asset").agg(F.sum("cap").alias("cap"))
    for m in config.methods:
        w = None
        if m == "equal_mean":
            w = rules.equal_top_n_mean(windows, config.k, by)
        elif m == "cap_weighted" and cap is not None:
            w = rules.top_n_cap(cap, config.k, by)
        elif m == "equal_cap" and cap is not None:
            w = rules.equal_top_n_cap(cap, config.k, by)
        elif m == "random":
            w = rules.random_n(assets, config.k, by)
        if w is not None:
            tables.append(w.withColumn("method", F.lit(m)))
    book = [*by, "method"]
    if fitted and members is None:
        fits = table(fit.fit_rolling(returns, benchmark, plan, config.lookback, fitted, (config.lam_frac,), cardinality=config.k))
        raw = rules.destandardize(fit.fit_weights(fits, book), fits.select(*book, F.inline("sigmas")), book, config.threshold)
        tables.append(rules.fallback_uniform(fits.select(*book), raw, fits.select(*book, F.explode("assets").alias("asset")), book))
    elif fitted:  # returns that depend on the rebalance can't be shared between windows
        x = panel.standardize(windows, centred=False, by=[*by, "asset"])
        y = benchmark.select("universe", "dt", F.col("r").alias("y"))
        fits = table(fit.fit_windows(x.join(y, ["universe", "dt"]), fitted, (config.lam_frac,), cardinality=config.k))
        raw = rules.destandardize(fit.fit_weights(fits, book), x.select(*by, "asset", "sigma").distinct(), book, config.threshold)
        tables.append(rules.fallback_uniform(fits.select(*book), raw, assets, book))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    if members is not None:
        active = windows.filter("active").select(*by, "asset").distinct().join(out.select(*by, "method").distinct(), by)
        out = rules.masked_weights(out, active, [*by, "method"])
    return out.select("universe", "method", "rebal_dt", "asset", "w")


def run(returns: DataFrame, benchmark: DataFrame, cash: DataFrame, config: Config, cost: Column | None = None, caps: DataFrame | None = None, members: DataFrame | None = None) -> dict[str, DataFrame]:
    """weights, nav, rebalances and bench (the benchmark's curve); ``benchmark`` as a method is that curve.

    survivorship_bias: whether the run had no membership table, so that its universe is that of the survivors.
    """
    returns = table(returns)  # read by every step below
    weights = table(target_weights(returns, benchmark, config, caps, members))
    days = panel.clip_dates(returns, config.start, config.end)
    out = accounting.walk(weights, days, cash, registry.cost(config.cost, **dict(config.cost_parameters)) if cost is None else cost, config.capital)
    curve = accounting.compounded(panel.clip_dates(benchmark, config.start, config.end), ["universe"], config.capital)
    nav = out["nav"]
    if "benchmark" in config.methods:
        nav = nav.unionByName(curve.withColumn("method", F.lit("benchmark")).select(*nav.columns))
    return {"weights": weights, "nav": nav, "rebalances": out["rebalances"], "bench": curve, "survivorship_bias": members is None}
