"""Share allocation and reports, for any number of accounts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import ranked_holdings
from .schedule import downsample, window_filter


def allocate(accounts: DataFrame, weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Whole shares per account: floor(capital * w / price); names without a positive price, or too dear for one share, are out.

    ``accounts``: account, universe, capital. ``weights``: universe, asset, w. ``prices``: universe, asset, price.
    """
    wanted = accounts.join(weights.filter("w > 0"), "universe").join(prices, ["universe", "asset"], "left")
    bought = wanted.filter("price > 0").withColumn("shares", F.floor(F.col("capital") * F.col("w") / F.col("price")).cast("long"))
    return bought.filter("shares > 0").select("account", "universe", "asset", "w", "price", "shares", F.round(F.col("shares") * F.col("price"), 2).alias("cost"))


def allocation_summary(accounts: DataFrame, weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Per account: invested, residual cash, utilization, names bought, and a warning for every name without a price."""
    bought = allocate(accounts, weights, prices).groupBy("account").agg(F.sum("cost").alias("invested"), F.count(F.lit(1)).alias("n_bought"))
    missing = accounts.join(weights.filter("w > 0"), "universe").join(prices.filter("price > 0"), ["universe", "asset"], "left_anti")
    warned = missing.groupBy("account").agg(F.sort_array(F.collect_list(F.concat(F.lit("no price: "), "asset"))).alias("warnings"))
    out = accounts.join(bought, "account", "left").join(warned, "account", "left")
    invested = F.coalesce("invested", F.lit(0.0))
    return out.select(
        "account",
        "universe",
        "capital",
        invested.alias("invested"),
        (F.col("capital") - invested).alias("residual"),
        F.format_string("%.1f%%", F.when(F.col("capital") > 0, invested / F.col("capital") * 100).otherwise(0.0)).alias("utilization"),
        F.coalesce("n_bought", F.lit(0).cast("long")).alias("n_bought"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )


def holdings_report(weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ranked holdings with the universe's reduction in percent. ``sizes``: universe, n."""
    ranked = ranked_holdings(weights, ["universe"])
    active = ranked.groupBy("universe").agg(F.count(F.lit(1)).alias("active"))
    cut = F.round((1 - F.col("active") / F.col("n")) * 100, 1)
    return ranked.join(active.join(sizes, "universe"), "universe").select("universe", "rank", "asset", "w", cut.alias("reduction_pct"))


def health(weights: DataFrame, k: int = 5) -> DataFrame:
    """Sum of weights and the ``k`` largest, as a map."""
    total = weights.groupBy("universe").agg(F.sum("w").alias("w_sum"), F.count(F.when(F.col("w") > 0, 1)).alias("n_active"))
    top = ranked_holdings(weights, ["universe"], k).groupBy("universe").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", "w")))).alias("top"))
    return total.join(top, "universe")


def series_report(curves: DataFrame, by: list[str], start: str | None = None, end: str | None = None, most: int = 100) -> DataFrame:
    """Curves inside a window, down-sampled per group."""
    return downsample(window_filter(curves, start, end), by, most)
