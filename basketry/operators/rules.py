"""Rule-based portfolios and weight post-processing. Ties go by value descending, then asset ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), "asset")
    return rows.withColumn("rn", F.row_number().over(order))


def _share(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    return rows.withColumn("w", value / F.sum(value).over(Window.partitionBy(*by)))


def top_n_cap(caps: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Cap weights over the ``n`` largest caps; null, NaN and non-positive caps are not eligible."""
    live = caps.filter("cap is not null and not isnan(cap) and cap > 0")
    return _share(_ranked(live, by, "cap").filter(F.col("rn") <= n), by, F.col("cap")).select(*by, "asset", "w")


def equal_top_n_cap(caps: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Equal weights over the ``n`` largest eligible caps."""
    live = caps.filter("cap is not null and not isnan(cap) and cap > 0")
    top = _ranked(live, by, "cap").filter(F.col("rn") <= n)
    return top.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by))).select(*by, "asset", "w")


def equal_top_n_mean(windows: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Equal weights over the ``n`` assets of the largest mean training return."""
    means = windows.groupBy(*by, "asset").agg(F.avg("r").alias("m"))
    top = _ranked(means, by, "m").filter(F.col("rn") <= n)
    return top.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by))).select(*by, "asset", "w")


def random_n(assets: DataFrame, n: int, by: list[str], seed: int = 0) -> DataFrame:
    """Equal weights over ``n`` assets in the order of a seeded hash; the same on any partitioning."""
    return random_ensemble(assets, n, by, n_seeds=1, base_seed=seed)


def random_ensemble(assets: DataFrame, n: int, by: list[str], n_seeds: int = 10, base_seed: int = 0) -> DataFrame:
    """The mean of ``n_seeds`` random portfolios. ``md5`` of seed and asset orders the draws, so SQL can repeat them."""
    seeds = assets.withColumn("seed", F.explode(F.sequence(F.lit(base_seed), F.lit(base_seed + n_seeds - 1))))
    order = Window.partitionBy(*by, "seed").orderBy(F.md5(F.concat_ws(":", "seed", "asset")), "asset")
    picked = seeds.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
    each = picked.withColumn("w1", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by, "seed")))
    mean = each.groupBy(*by, "asset").agg((F.sum("w1") / n_seeds).alias("w1"))
    return _share(mean, by, F.col("w1")).select(*by, "asset", "w")


def to_simplex(weights: DataFrame, by: list[str], threshold: float = 1e-4, universe: DataFrame | None = None) -> DataFrame:
    """Weights below ``threshold`` are cut, the rest sum to 1. Fits with nothing left are uniform over ``universe`` if given."""
    kept = weights.filter(F.col("w") >= threshold)
    total = kept.groupBy(*by).agg(F.sum("w").alias("total")).filter("total >= 1e-12")
    out = kept.join(total, by).withColumn("w", F.col("w") / F.col("total")).select(*by, "asset", "w")
    if universe is None:
        return out
    empty = weights.select(*by).distinct().join(total, by, "left_anti")
    return out.unionByName(uniform(empty.join(universe, [c for c in by if c in universe.columns]), by))


def uniform(assets: DataFrame, by: list[str]) -> DataFrame:
    size = assets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return assets.join(size, by).select(*by, "asset", (1.0 / F.col("n")).alias("w"))


def destandardize(weights: DataFrame, stats: DataFrame, by: list[str], threshold: float = 1e-4) -> DataFrame:
    """w / sigma on the simplex. ``stats``: by, asset, sigma."""
    raw = weights.join(stats.select(*[c for c in by if c in stats.columns], "asset", "sigma"), [*[c for c in by if c in stats.columns], "asset"])
    safe = F.when(F.col("sigma") > 1e-12, F.col("sigma")).otherwise(1.0)
    return to_simplex(to_simplex(raw.withColumn("w", F.col("w") / safe).select(*by, "asset", "w"), by, 0.0), by, threshold)


def fallback_uniform(fits: DataFrame, weights: DataFrame, assets: DataFrame, by: list[str]) -> DataFrame:
    """``weights``, and uniform ones for the ``fits`` without any weight."""
    missing = fits.join(weights.select(*by).distinct(), by, "left_anti")
    return weights.select(*by, "asset", "w").unionByName(uniform(missing.join(assets, [c for c in by if c in assets.columns]), by))


def masked_weights(weights: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """Members' weights on the simplex; if none is left, equal weights over the members. ``members``: by, asset."""
    inside = weights.join(members, [*by, "asset"], "left_semi").filter("w > 0")
    scaled = to_simplex(inside, by, 0.0)
    return fallback_uniform(weights.select(*by).distinct(), scaled, members, by)


def vector_stats(weights: DataFrame, by: list[str], threshold: float = 1e-6) -> DataFrame:
    """Active names, Herfindahl index, effective number, sum, largest and least active weight."""
    active = F.when(F.col("w") > threshold, F.col("w"))
    hhi = F.sum(F.col("w") * F.col("w"))
    return weights.groupBy(*by).agg(
        F.count(active).alias("n_active"), hhi.alias("hhi"), F.when(hhi > 0, 1.0 / hhi).alias("effective_n"), F.sum("w").alias("w_sum"), F.max("w").alias("w_max"), F.min(active).alias("w_min_active")
    )


def summary(weights: DataFrame, by: list[str], k: int = 15) -> DataFrame:
    """:func:`vector_stats` and ``top``: the ``k`` largest holdings in order, as (rank, asset, w, pct)."""
    top = ranked_holdings(weights, by, k).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "asset", "w", (F.col("w") * 100).alias("pct")))).alias("top"))
    return vector_stats(weights, by).join(top, by, "left")


def ranked_holdings(weights: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """Active weights by rank, the first ``k`` if given."""
    out = _ranked(weights.filter("w > 0"), by, "w").withColumnRenamed("rn", "rank")
    return out if k is None else out.filter(F.col("rank") <= k)
