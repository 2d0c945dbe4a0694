"""Moments that feed the fits: Gram matrices, X'y, penalty bounds and grids, in long form.

``windows`` has the columns of ``by`` (universe and window), dt, asset, x and y.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = ["universe", "rebal_dt"]
#: Penalties as fractions of the largest useful one.
FRACTIONS = (0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50)


def gram(windows: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """sum(x_i * x_j) for i <= j: (by, i, j, g). A date's assets meet once, by equality on window and date."""
    left = windows.select(*by, "dt", F.col("asset").alias("i"), F.col("x").alias("xi"))
    right = windows.select(*by, "dt", F.col("asset").alias("j"), F.col("x").alias("xj"))
    return left.join(right, [*by, "dt"]).filter("i <= j").groupBy(*by, "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("g"))


def xty(windows: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    return windows.groupBy(*by, "asset").agg(F.sum(F.col("x") * F.col("y")).alias("c"))


def lambda_max(windows: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """The least penalty with an empty fit: the largest X'y, at least 1e-10."""
    return xty(windows, by).groupBy(*by).agg(F.greatest(F.max("c"), F.lit(1e-10)).alias("lam_max"))


def largest_eigenvalue(windows: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """(by, p, eigenvalue) of each window's Gram matrix, the bound of a gradient step; a window is one group."""
    kinds = dict(windows.dtypes)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(rows.pivot(index="dt", columns="asset", values="x").to_numpy(dtype=float))
        small = x @ x.T if x.shape[0] < x.shape[1] else x.T @ x  # the same largest eigenvalue
        return pd.DataFrame([(*key, x.shape[1], float(np.linalg.eigvalsh(small)[-1]))], columns=[*by, "p", "eigenvalue"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "p long", "eigenvalue double"])
    return windows.select(*by, "dt", "asset", "x").groupBy(*by).applyInPandas(run, schema)


def lambda_grid(bounds: DataFrame, n: int = 20, ratio: float = 1e-3) -> DataFrame:
    """``n`` log-spaced penalties from ratio * lam_max up to lam_max."""
    rows = bounds.withColumn("lam_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("lam", F.col("lam_max") * F.pow(F.lit(ratio), 1 - F.col("lam_idx") / (n - 1)))


def fraction_grid(bounds: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    rows = bounds.select("*", F.posexplode(F.array(*map(F.lit, fractions))).alias("lam_idx", "lam_frac"))
    return rows.withColumn("lam", F.col("lam_frac") * F.col("lam_max"))


def bic(n: Column, rss: Column, k: Column) -> Column:
    """n ln(rss / n) + k ln n; minus infinity without residual."""
    return F.when(rss <= 0, F.lit(float("-inf"))).otherwise(n * F.log(rss / n) + k * F.log(n))


def ebic(n: Column, rss: Column, k: Column, p: Column, gamma: float = 0.5) -> Column:
    if not 0 <= gamma <= 1:
        raise ValueError("gamma must lie in [0, 1]")
    return bic(n, rss, k) + 2 * gamma * k * F.log(p)


def select_lambda(path: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Each group's row of the least score, the first on ties. NaN and null scores lose."""
    cols = [c for c in path.columns if c not in by]
    order = F.struct(F.col(score).isNull(), F.isnan(score), F.col(score), F.col("lam_idx"))
    return path.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("s")).select(*by, "s.*")
