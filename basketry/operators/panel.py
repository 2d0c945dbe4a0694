"""Panels: long tables (universe, dt, asset, price) and (universe, dt, asset, r), never wide.

Every function takes and returns DataFrames. Dates are ranked on the calendar (one row per universe and date), not on the
panel, so that no window holds more than one asset's or one universe's dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["universe", "asset"]


def _by_date() -> Window:
    return Window.partitionBy(*SERIES).orderBy("dt")


# ---- returns ---------------------------------------------------------------------------------------


def simple_returns(prices: DataFrame) -> DataFrame:
    """p_t / p_{t-1} - 1; an asset's first row is dropped."""
    before = F.lag("price").over(_by_date())
    return prices.withColumn("r", F.col("price") / before - 1).filter("r is not null").select("universe", "dt", "asset", "r")


def log_returns(prices: DataFrame) -> DataFrame:
    """ln(p_t / p_{t-1}); an asset's first row is dropped."""
    before = F.lag("price").over(_by_date())
    return prices.withColumn("r", F.log(F.col("price") / before)).filter("r is not null").select("universe", "dt", "asset", "r")


def densify(prices: DataFrame) -> DataFrame:
    """One row per date and asset of a universe; missing prices are null."""
    dates, assets = prices.select("universe", "dt").distinct(), prices.select(*SERIES).distinct()
    return dates.join(assets, "universe").join(prices.select("universe", "dt", "asset", "price"), ["universe", "dt", "asset"], "left")


def padded_returns(prices: DataFrame) -> DataFrame:
    """Simple returns on every date, gaps filled forward; a return without a price before it is 0."""
    by = _by_date()
    filled = densify(prices).withColumn("price", F.last("price", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("r", F.coalesce(F.col("price") / F.lag("price").over(by) - 1, F.lit(0.0))).select("universe", "dt", "asset", "r")


# ---- alignment -------------------------------------------------------------------------------------


def align(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Inner join on date with ``benchmark`` (universe, dt, r) as column y."""
    return returns.join(benchmark.select("universe", "dt", F.col("r").alias("y")), ["universe", "dt"])


def complete_assets(panel: DataFrame, value: str = "r") -> DataFrame:
    """Rows of the assets that have a value on every date of their universe."""
    dates = panel.groupBy("universe").agg(F.countDistinct("dt").alias("n_dates"))
    full = panel.groupBy(*SERIES).agg(F.count(value).alias("n")).join(dates, "universe").filter("n = n_dates").select(*SERIES)
    return panel.join(full, SERIES, "left_semi")


def drop_empty_dates(panel: DataFrame, value: str = "r") -> DataFrame:
    """Rows of the dates on which some asset has a value."""
    some = panel.groupBy("universe", "dt").agg(F.count(value).alias("n")).filter("n > 0").select("universe", "dt")
    return panel.join(some, ["universe", "dt"], "left_semi")


def calendar(panel: DataFrame) -> DataFrame:
    """(universe, dt, pos): dates of a universe numbered from 0."""
    by = Window.partitionBy("universe").orderBy("dt")
    return panel.select("universe", "dt").distinct().withColumn("pos", (F.row_number().over(by) - 1).cast("int"))


def last_n(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the last ``n`` dates; universes with fewer dates vanish (see ``too_short``)."""
    cal = calendar(panel)
    size = cal.groupBy("universe").agg(F.count(F.lit(1)).alias("n_dates")).filter(F.col("n_dates") >= n)
    keep = cal.join(size, "universe").filter(F.col("pos") >= F.col("n_dates") - n).select("universe", "dt")
    return panel.join(keep, ["universe", "dt"], "left_semi")


def too_short(panel: DataFrame, n: int) -> DataFrame:
    """(universe, n_dates) of universes with fewer than ``n`` dates."""
    return panel.groupBy("universe").agg(F.countDistinct("dt").alias("n_dates")).filter(F.col("n_dates") < n)


def split(panel: DataFrame, n_train: int, n_test: int) -> DataFrame:
    """Adds split: the first ``n_train`` dates are train, the next ``n_test`` test; later ones are dropped."""
    at = calendar(panel).withColumn("split", F.when(F.col("pos") < n_train, "train").when(F.col("pos") < n_train + n_test, "test"))
    return panel.join(at.filter("split is not null").select("universe", "dt", "split"), ["universe", "dt"])


def varying_assets(panel: DataFrame, least: float = 1e-12, where: Column | None = None) -> DataFrame:
    """Rows of the assets whose population variance over ``where`` (all rows, or training rows) exceeds ``least``."""
    base = panel if where is None else panel.filter(where)
    keep = base.groupBy(*SERIES).agg(F.var_pop("r").alias("v")).filter(F.col("v") > least).select(*SERIES)
    return panel.join(keep, SERIES, "left_semi")


def asset_stats(panel: DataFrame, by: list[str] = SERIES, where: Column | None = None) -> DataFrame:
    """Mean and population deviation of each asset, from ``where`` rows only."""
    base = panel if where is None else panel.filter(where)
    return base.groupBy(*by).agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sigma"))


def standardize(panel: DataFrame, centred: bool = True, by: list[str] = SERIES, where: Column | None = None, least: float = 1e-12) -> DataFrame:
    """Adds x: (r - mu) / sigma, or r / sigma. Deviations up to ``least`` count as 1."""
    stats = asset_stats(panel, by, where)
    safe = F.when(F.col("sigma") > least, F.col("sigma")).otherwise(1.0)
    top = F.col("r") - F.col("mu") if centred else F.col("r")
    return panel.join(stats, by).withColumn("x", top / safe).withColumn("sigma", safe)


def without_benchmark(assets: DataFrame, index_meta: DataFrame) -> DataFrame:
    """A universe's assets other than its own benchmark."""
    own = index_meta.select("universe", F.col("benchmark").alias("asset"))
    return assets.join(own, SERIES, "left_anti")


def with_cash(calendar_: DataFrame, cash: DataFrame) -> DataFrame:
    """Adds cash, 0 where the cash table has no date."""
    return calendar_.join(cash.select("dt", F.col("r").alias("cash")), "dt", "left").withColumn("cash", F.coalesce("cash", F.lit(0.0)))


def clip_dates(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included and both optional."""
    if start:
        panel = panel.filter(F.col("dt") >= F.lit(start).cast("date"))
    return panel.filter(F.col("dt") <= F.lit(end).cast("date")) if end else panel


def coverage(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Per universe: first and last date, and whether they fall short of [start, end]."""
    got = panel.groupBy("universe").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    return got.withColumns({"starts_late": F.col("first_dt") > F.lit(start).cast("date"), "ends_early": F.col("last_dt") < F.lit(end).cast("date")})


def cap_universe(universe: DataFrame, threshold: int = 750, keep: int = 120) -> DataFrame:
    """(universe, asset, ord): universes of more than ``threshold`` assets keep the first ``keep`` in list order."""
    size = universe.groupBy("universe").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("universe").orderBy("ord", "asset")
    ranked = universe.withColumn("rn", F.row_number().over(by)).join(size, "universe")
    return ranked.filter((F.col("n") <= threshold) | (F.col("rn") <= keep)).select("universe", "asset", "ord")


def benchmark_fallback(candidates: DataFrame) -> DataFrame:
    """(universe, rank, candidate, dt, price) -> the rows of each universe's first candidate that has prices."""
    first = candidates.filter("price is not null").groupBy("universe").agg(F.min("rank").alias("rank"))
    return candidates.join(first, ["universe", "rank"], "left_semi").filter("price is not null")


# ---- symbols and caps ------------------------------------------------------------------------------


def clean_symbol(symbol: Column, suffix: str = "") -> Column:
    """Upper case, trimmed, footnotes cut, dots as dashes; null for blanks, dashes and 'nan'."""
    s = F.upper(F.trim(F.regexp_replace(symbol, r"\[[^\]]*\]", "")))
    s = F.when(~s.isin("", "-", "NAN"), s)
    if not suffix:
        return F.translate(s, ".", "-")
    return F.when(s.endswith(suffix), s).otherwise(F.concat(s, F.lit(suffix)))


def first_distinct(rows: DataFrame, value: str, pos: str) -> DataFrame:
    """Each value once, at its first position."""
    return rows.groupBy(value).agg(F.min(pos).alias(pos))


def of_class(rows: DataFrame, column: str, word: str = "equity") -> DataFrame:
    """Rows whose class contains ``word``, in any case; null never does."""
    return rows.filter(F.lower(F.coalesce(F.col(column), F.lit(""))).contains(word))


def normalized_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), "[ -]", ""))


def lookup_index(names: DataFrame, index_meta: DataFrame) -> DataFrame:
    """(name) -> name, universe; universe is null for unknown names."""
    meta = index_meta.select("universe", normalized_name(F.col("universe")).alias("key"))
    return names.withColumn("key", normalized_name(F.col("name"))).join(meta, "key", "left").select("name", "universe")


def resolved_cap(cap: Column, shares: Column, price: Column, prev_close: Column) -> Column:
    """The cap, else shares times price (the close before where the price is 0 or null), else null."""
    return F.coalesce(cap, shares * F.coalesce(F.when(price != 0, price), prev_close))


def keys_to_refresh(requested: DataFrame, cache: DataFrame, refetch_missing: bool = False) -> DataFrame:
    """Requested assets that are not cached, or cached as null if ``refetch_missing``."""
    known = cache.select("asset", "cap", F.lit(True).alias("cached"))
    wanted = F.col("cached").isNull() | (F.lit(refetch_missing) & F.col("cap").isNull())
    return requested.join(known, "asset", "left").filter(wanted).select("asset")


def upsert_caps(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh caps win where they are not null."""
    new = fresh.select("asset", F.col("cap").alias("new"))
    return cache.join(new, "asset", "full_outer").select("asset", F.coalesce("new", "cap").alias("cap"))


def caps_for(assets: DataFrame, caps: DataFrame, fallback: float | None = None) -> DataFrame:
    """The assets' caps, ``fallback`` where unknown."""
    out = assets.join(caps.select("asset", "cap"), "asset", "left")
    return out if fallback is None else out.withColumn("cap", F.coalesce("cap", F.lit(fallback)))


def proxy_caps(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """Price times shares, or the price alone."""
    return prices.join(shares, "asset", "left").withColumn("cap", F.col("price") * F.coalesce("shares", F.lit(1.0))).drop("shares")


def latest_prices(prices: DataFrame) -> DataFrame:
    """Each asset's last price that is not null."""
    return prices.filter("price is not null").groupBy(*SERIES).agg(F.max_by("price", "dt").alias("price"), F.max("dt").alias("dt"))


def portfolio_returns(returns: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Sum of w * r by ``by`` and date. ``weights`` has universe, asset, w and ``by``."""
    joined = returns.join(weights, SERIES)
    return joined.groupBy("universe", *by, "dt").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def pivoted(series: DataFrame, methods: list[str], value: str = "nav") -> DataFrame:
    """One row per universe and date, a column per method; dates of any method stay."""
    return series.groupBy("universe", "dt").pivot("method", methods).agg(F.first(value))
