"""Walk-forward accounting as set-based queries: segments, drift, trades, costs, turnover and the NAV path.

A day loop is not needed. Between two rebalances, weights drift with their own returns; over them, NAV is a product:

    nav_t = capital * (cash growth before the first fit) * product(1 - c_k * S_k, k <= seg(t)) * product(G_k, k < seg(t)) * g_t

with g_t the book's growth since its segment began, G_k its growth over the whole of segment k, S_k the traded share of NAV at k and c_k the
cost per unit traded. Only one row per segment meets in the windows over segments.

Tables: weights (universe, method, rebal_dt, asset, w); returns (universe, dt, asset, r). A rebalance takes effect before its own
day's return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table

BOOK = ["universe", "method"]


# ---- costs per unit traded -------------------------------------------------------------------------


def no_cost() -> Column:
    return F.lit(0.0)


def linear_cost(bps: float) -> Column:
    if bps < 0:
        raise ValueError("bps must not be negative")
    return F.lit(bps * 1e-4)


def sqrt_impact_cost(kappa: float, sigma: float, participation: float) -> Column:
    if min(kappa, sigma, participation) < 0:
        raise ValueError("impact parameters must not be negative")
    return F.lit(kappa * sigma * participation**0.5)


# ---- segments and drift ----------------------------------------------------------------------------


def segments(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """(universe, method, dt, rebal_dt): the last rebalance on or before each date of ``dates``; null before the first."""
    rebal = weights.select(*BOOK, "rebal_dt").distinct()
    days = dates.select("universe", "dt").distinct().join(rebal.select(*BOOK).distinct(), "universe")
    at = days.join(rebal.withColumn("dt", F.col("rebal_dt")), [*BOOK, "dt"], "left")
    by = Window.partitionBy(*BOOK).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("rebal_dt", F.last("rebal_dt", ignorenulls=True).over(by))


def growth(weights: DataFrame, returns: DataFrame, segs: DataFrame) -> DataFrame:
    """(universe, method, rebal_dt, dt, asset, d): each position's value per unit of NAV at the segment's start, after day dt."""
    held = segs.filter("rebal_dt is not null").join(weights.filter("w > 0"), [*BOOK, "rebal_dt"]).join(returns, ["universe", "dt", "asset"])
    by = Window.partitionBy(*BOOK, "rebal_dt", "asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("d", F.col("w") * F.product(1 + F.col("r")).over(by)).select(*BOOK, "rebal_dt", "dt", "asset", "d")


def drifted(positions: DataFrame) -> DataFrame:
    """Adds w: the drifted weight, d over the book's sum on that day."""
    total = positions.groupBy(*BOOK, "rebal_dt", "dt").agg(F.sum("d").alias("g"))
    return positions.join(total, [*BOOK, "rebal_dt", "dt"]).withColumn("w", F.col("d") / F.col("g"))


def _with_next(weights: DataFrame) -> DataFrame:
    """(universe, method, rebal_dt, next_dt): each rebalance and the one after it."""
    by = Window.partitionBy(*BOOK).orderBy("rebal_dt")
    return weights.select(*BOOK, "rebal_dt").distinct().withColumn("next_dt", F.lead("rebal_dt").over(by))


def trades(weights: DataFrame, positions: DataFrame) -> DataFrame:
    """(universe, method, rebal_dt, asset, dw): target less drifted weight. Names that leave or enter count in full."""
    last = positions.groupBy(*BOOK, "rebal_dt").agg(F.max("dt").alias("dt"))
    closing = drifted(positions.join(last, [*BOOK, "rebal_dt", "dt"], "left_semi")).join(_with_next(weights), [*BOOK, "rebal_dt"]).filter("next_dt is not null")
    old = closing.select(*BOOK, F.col("next_dt").alias("rebal_dt"), "asset", F.col("w").alias("old"))
    new = weights.filter("w > 0").select(*BOOK, "rebal_dt", "asset", F.col("w").alias("new"))
    zero = F.lit(0.0)
    return new.join(old, [*BOOK, "rebal_dt", "asset"], "full_outer").select(*BOOK, "rebal_dt", "asset", (F.coalesce("new", zero) - F.coalesce("old", zero)).alias("dw"))


def turnover(weights: DataFrame) -> DataFrame:
    """Half the absolute change from the target before (not the drifted book); the first rebalance counts half its weights."""
    new = weights.filter("w > 0").select(*BOOK, "rebal_dt", "asset", F.col("w").alias("new"))
    old = weights.filter("w > 0").join(_with_next(weights), [*BOOK, "rebal_dt"]).filter("next_dt is not null")
    old = old.select(*BOOK, F.col("next_dt").alias("rebal_dt"), "asset", F.col("w").alias("old"))
    zero = F.lit(0.0)
    both = new.join(old, [*BOOK, "rebal_dt", "asset"], "full_outer")
    return both.groupBy(*BOOK, "rebal_dt").agg((0.5 * F.sum(F.abs(F.coalesce("new", zero) - F.coalesce("old", zero)))).alias("turnover"))


def nav_path(weights: DataFrame, returns: DataFrame, cash: DataFrame, cost: Column, capital: float = 1e6) -> DataFrame:
    """(universe, method, dt, nav). ``cash``: universe, dt, cash, which NAV earns before the first fit."""
    return walk(weights, returns, cash, cost, capital)["nav"]


def walk(weights: DataFrame, returns: DataFrame, cash: DataFrame, cost: Column, capital: float = 1e6) -> dict[str, DataFrame]:
    """nav, and rebalances (universe, method, rebal_dt, traded, cost in money, turnover)."""
    dates = returns.select("universe", "dt").distinct()
    segs = segments(weights, dates)
    held = table(growth(weights, returns, segs))  # read three times
    traded = trades(weights, held).groupBy(*BOOK, "rebal_dt").agg(F.sum(F.abs("dw")).alias("traded"))
    daily = held.groupBy(*BOOK, "rebal_dt", "dt").agg(F.sum("d").alias("g"))
    whole = daily.groupBy(*BOOK, "rebal_dt").agg(F.max_by("g", "dt").alias("g_all"))

    order = Window.partitionBy(*BOOK).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    early = segs.filter("rebal_dt is null").join(cash.select("universe", "dt", "cash"), ["universe", "dt"], "left")
    early = early.withColumn("nav", capital * F.product(1 + F.coalesce("cash", F.lit(0.0))).over(order)).select(*BOOK, "dt", "nav")
    opening = early.groupBy(*BOOK).agg(F.max_by("nav", "dt").alias("opening"))

    by = Window.partitionBy(*BOOK).orderBy("rebal_dt")
    kept = F.greatest(F.lit(0.0), 1 - cost * F.col("traded"))
    chain = whole.join(traded, [*BOOK, "rebal_dt"]).join(opening, BOOK, "left")
    before = F.coalesce(F.product("g_all").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    paid = F.coalesce(F.product(kept).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    chain = chain.withColumn("before", F.coalesce("opening", F.lit(float(capital))) * before * paid).withColumn("base", F.col("before") * kept)
    late = daily.join(chain.select(*BOOK, "rebal_dt", "base"), [*BOOK, "rebal_dt"]).select(*BOOK, "dt", (F.col("base") * F.col("g")).alias("nav"))
    rebalances = chain.select(*BOOK, "rebal_dt", "traded", (F.col("before") - F.col("base")).alias("cost")).join(turnover(weights), [*BOOK, "rebal_dt"])
    return {"nav": early.unionByName(late), "rebalances": rebalances}


def compounded(series: DataFrame, by: list[str], start: float = 100.0, name: str = "nav") -> DataFrame:
    """``start`` times the running product of 1 + r, per group in date order (benchmark and rebased curves)."""
    order = Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(name, start * F.product(1 + F.col("r")).over(order)).select(*by, "dt", name)


def chained(curves: DataFrame, by: list[str]) -> DataFrame:
    """Train and test as one line: running products of 1 + p and 1 + b from 1, where the test part goes on from the end of the train part.

    ``curves``: by, split, dt, p, b. Each part compounds by itself; the train part's last value is one row per group.
    """
    order = Window.partitionBy(*by, "split").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    own = curves.select(*by, "split", "dt", F.product(1 + F.col("p")).over(order).alias("p"), F.product(1 + F.col("b")).over(order).alias("b"))
    ends = own.filter("split = 'train'").groupBy(*by).agg(F.max_by("p", "dt").alias("p0"), F.max_by("b", "dt").alias("b0"))
    factor = lambda c: F.when(F.col("split") == "test", F.coalesce(c, F.lit(1.0))).otherwise(1.0)
    return own.join(ends, by, "left").select(*by, "split", "dt", (F.col("p") * factor(F.col("p0"))).alias("portfolio"), (F.col("b") * factor(F.col("b0"))).alias("benchmark"))
