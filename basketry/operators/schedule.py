"""Calendars: rebalance schedules, rolling windows, membership, bounded as-of joins, regimes, down-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import calendar


def weekly(panel: DataFrame) -> DataFrame:
    """(universe, rebal_dt, rpos): the last date of every ISO week."""
    year, week = F.extract(F.lit("YEAROFWEEK"), "dt"), F.weekofyear("dt")
    return calendar(panel).groupBy("universe", year.alias("y"), week.alias("w")).agg(F.max("dt").alias("rebal_dt"), F.max("pos").alias("rpos")).drop("y", "w")


def monthly(panel: DataFrame) -> DataFrame:
    """(universe, rebal_dt, rpos): the last date of every month."""
    return calendar(panel).groupBy("universe", F.trunc("dt", "MM").alias("m")).agg(F.max("dt").alias("rebal_dt"), F.max("pos").alias("rpos")).drop("m")


def train_windows(returns: DataFrame, schedule: DataFrame, lookback: int) -> DataFrame:
    """The ``lookback`` dates strictly before each rebalance; rebalances with fewer have no rows.

    A range join without a nested loop: every rebalance lists its positions, which meet the calendar by equality.
    """
    full = schedule.filter(F.col("rpos") >= lookback)
    wanted = full.select("universe", "rebal_dt", F.explode(F.sequence(F.col("rpos") - lookback, F.col("rpos") - 1)).alias("pos"))
    dates = wanted.join(calendar(returns), ["universe", "pos"]).select("universe", "rebal_dt", "dt")
    return dates.join(returns, ["universe", "dt"])


def masked(windows: DataFrame, membership: DataFrame) -> DataFrame:
    """Training returns with non-members at 0. A rebalance date that the overlay does not list has everyone as a member."""
    listed = membership.select("universe", F.col("dt").alias("rebal_dt"), F.lit(True).alias("listed")).distinct()
    member = membership.select("universe", F.col("dt").alias("rebal_dt"), "asset", F.lit(True).alias("member"))
    out = windows.join(listed, ["universe", "rebal_dt"], "left").join(member, ["universe", "rebal_dt", "asset"], "left")
    active = F.col("listed").isNull() | F.col("member").isNotNull()
    return out.withColumns({"active": active, "r": F.when(active, F.col("r")).otherwise(0.0)}).drop("listed", "member")


def align_factors(dates: DataFrame, factors: DataFrame, names: list[str], limit: int = 3) -> DataFrame:
    """Factors on the given (universe, dt): missing ones are filled from at most ``limit`` rows before, else dropped."""
    by = Window.partitionBy("universe").orderBy("dt").rowsBetween(-limit, 0)
    joined = dates.join(factors.select("dt", *names), "dt", "left")
    return joined.select("universe", "dt", *[F.last(n, ignorenulls=True).over(by).alias(n) for n in names]).dropna(subset=names)


def assign_regimes(rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """Rows once for each regime with start_dt <= dt < end_dt; regimes may overlap.

    The regimes are exploded to months, so dates meet them by equality and only the bounds are compared after that.
    """
    months = F.sequence(F.trunc("start_dt", "MM"), F.trunc("end_dt", "MM"), F.expr("interval 1 month"))
    spread = regimes.withColumn("m", F.explode(months))
    return rows.withColumn("m", F.trunc("dt", "MM")).join(spread, "m").filter("dt >= start_dt and dt < end_dt").drop("m")


def parse_bound(text) -> F.Column:
    """A date bound given as text; null if it is none."""
    return F.expr(f"try_cast({'null' if text is None else repr(str(text))} as date)")


def window_filter(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows in [start, end]; a bound that is absent or no date does not filter."""
    lo, hi = parse_bound(start), parse_bound(end)
    return rows.filter((lo.isNull() | (F.col("dt") >= lo)) & (hi.isNull() | (F.col("dt") <= hi)))


def downsample(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Every ceil(n / most)-th row of each group in date order, and the last one."""
    order = Window.partitionBy(*by).orderBy("dt")
    ranked = rows.withColumns({"_rn": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    keep = ((F.col("_rn") - 1) % F.ceil(F.col("_n") / F.lit(most)) == 0) | (F.col("_rn") == F.col("_n"))
    return ranked.filter(keep).drop("_rn", "_n")


def span_years(rows: DataFrame, by: list[str]) -> DataFrame:
    """Years between a group's first and last date, days / 365.25; null if none."""
    days = F.datediff(F.max("dt"), F.min("dt"))
    return rows.groupBy(*by).agg(F.when(days > 0, days / 365.25).alias("years"))
