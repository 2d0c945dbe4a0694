"""Sparse fits as one grouped job: every (universe, window) is a group, its penalties and methods share one Gram matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, registry
from ..session import ship
from . import schedule
from .moments import FRACTIONS, WINDOW

FIT = "method string, lam_idx int, lam_frac double, lam double, lam_max double, n long, p long, nnz long, rss double, tss double, objective double, iterations int, converged boolean, weights array<struct<asset: string, w: double>>, trace array<struct<iter: int, primal: double, dual: double, obj: double>>"


COLUMNS = ["method", "lam_idx", "lam_frac", "lam", "lam_max", "n", "p", "nnz", "rss", "tss", "objective", "iterations", "converged", "weights", "trace"]


def _fits_of(chosen: dict[str, registry.Solver], m: registry.Moments, tss: float, assets: np.ndarray, fractions, lams) -> list[tuple]:
    """The rows of COLUMNS of one window: every method and penalty, from large penalties to small."""
    top = max(float(m.c.max()), 1e-10)
    grid = [(i, v / top, v) for i, v in enumerate(lams)] or [(i, f, f * top) for i, f in enumerate(fractions)]
    out = []
    for method, solver in chosen.items():
        start = None
        for i, f, lam in sorted(grid, key=lambda t: -t[2]) if solver.penalised else [(0, None, 0.0)]:
            w, k, done, trace = solver.weights(m, lam, start)
            start = w if solver.warm else None
            rss = max(float(m.yy - 2 * m.c @ w + w @ m.g @ w), 0.0)
            held = np.flatnonzero(w > 0)
            weights = [{"asset": assets[j], "w": float(w[j])} for j in held]
            steps = [dict(zip(("iter", "primal", "dual", "obj"), t, strict=True)) for t in trace]
            out.append((method, i, f, lam, top, m.n, len(m.c), len(held), rss, tss, 0.5 * rss + lam * float(w.sum()), k, done, weights, steps))
    return out


def fit_windows(windows: DataFrame, methods: tuple[str, ...] = ("fista",), fractions: tuple[float, ...] = FRACTIONS, lams: tuple[float, ...] = (), cardinality: int = 10, by: list[str] = WINDOW) -> DataFrame:
    """One row per window, method and penalty; ``windows`` has by, dt, asset, x and y.

    Methods are the solvers of :mod:`..functions.registry`: fista, cd and admm (three ways to one minimizer), reweighted and reweighted_relative, omp (one row, ``cardinality`` assets), and
    those a user has registered. Penalties are ``lams``, or fractions of the window's largest useful one. A window is a group of dates x assets; its penalties run from large to small with warm
    starts. A return that is missing in a window counts as 0.
    """
    ship(windows.sparkSession)
    kinds = dict(windows.dtypes)
    chosen = {m: registry.solver(m) for m in methods}

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="dt", columns="asset", values="x").sort_index()
        x, assets = np.nan_to_num(wide.to_numpy(dtype=float)), wide.columns.to_numpy()
        y = rows.groupby("dt")["y"].first().sort_index().to_numpy(dtype=float)
        m = registry.Moments(x.T @ x, x.T @ y, float(y @ y), len(y), cardinality)
        out = _fits_of(chosen, m, float(((y - y.mean()) ** 2).sum()), assets, fractions, lams)
        return pd.DataFrame([(*key, *row) for row in out], columns=[*by, *COLUMNS])

    return windows.select(*by, "dt", "asset", "x", "y").groupBy(*by).applyInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], FIT]))


ROLLED = FIT + ", sigmas array<struct<asset: string, sigma: double>>, assets array<string>"


def rolled_dates(returns: DataFrame, benchmark: DataFrame, plan: DataFrame, lookback: int, chunk: int) -> DataFrame:
    """(universe, chunk, pos, y, cells, plans): the dates that the rebalances of a chunk train on, each once a chunk. See :func:`fit_rolling`."""
    cal = schedule.calendar(returns)
    y = benchmark.select("universe", "dt", F.col("r").alias("y"))
    cross = returns.groupBy("universe", "dt").agg(F.collect_list(F.struct("asset", "r")).alias("cells")).join(cal, ["universe", "dt"]).join(y, ["universe", "dt"], "left").drop("dt")
    full = plan.filter(F.col("rpos") >= lookback).withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("universe").orderBy("rpos")) - 1) / chunk))
    chunks = full.groupBy("universe", "chunk").agg(F.min("rpos").alias("lo"), F.max("rpos").alias("hi"), F.sort_array(F.collect_list(F.struct("rpos", "rebal_dt"))).alias("plans"))
    wanted = chunks.select("universe", "chunk", F.explode(F.sequence(F.col("lo") - lookback, F.col("hi") - 1)).alias("pos"), F.when(F.col("pos") == F.col("hi") - 1, F.col("plans")).alias("plans"))
    return wanted.join(cross, ["universe", "pos"])


def fit_rolling(returns: DataFrame, benchmark: DataFrame, plan: DataFrame, lookback: int, methods: tuple[str, ...] = ("fista",), fractions: tuple[float, ...] = FRACTIONS, lams: tuple[float, ...] = (), cardinality: int = 10, chunk: int = 12) -> DataFrame:
    """The fits of :func:`fit_windows` on the ``lookback`` dates before each rebalance of ``plan`` (universe, rebal_dt, rpos), with returns divided by their deviations in the window.

    A date is one row with its cross-section, and it is dealt to a chunk of ``chunk`` neighbouring rebalances at a time, not to each window: it is copied 1 + lookback / (dates of a chunk) times
    instead of lookback / (dates between rebalances) times. In a chunk, X'X and X'y are made once for each block of dates between two neighbouring bounds of windows, and a window's are the sum of its
    whole blocks; there are no edges, and nothing is subtracted. A task holds the dates of one chunk.

    Two more columns than the other fits: ``sigmas`` of the assets with weights, and all ``assets`` of the window.
    """
    ship(returns.sparkSession)
    kinds = dict(returns.dtypes)
    chosen = {m: registry.solver(m) for m in methods}

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        pos, y = rows["pos"].to_numpy(), rows["y"].to_numpy(dtype=float)
        names = sorted({c["asset"] for cells in rows["cells"] for c in cells})
        place = {a: i for i, a in enumerate(names)}
        r = np.full((len(rows), len(names)), np.nan)
        for i, cells in enumerate(rows["cells"]):
            for c in cells:
                r[i, place[c["asset"]]] = np.nan if c["r"] is None else c["r"]
        known = ~np.isnan(y)
        x, z = np.where(known[:, None], np.nan_to_num(r), 0.0), np.nan_to_num(y)
        plans = next(p for p in rows["plans"] if p is not None)
        bounds = sorted({b for p in plans for b in (p["rpos"], p["rpos"] - lookback)})
        cut = np.searchsorted(pos, bounds)
        blocks = [(x[a:b].T @ x[a:b], x[a:b].T @ z[a:b], float(z[a:b] @ z[a:b])) for a, b in zip(cut, cut[1:])]
        out = []
        for p in plans:
            first, last = bounds.index(p["rpos"] - lookback), bounds.index(p["rpos"])
            a, b = cut[first], cut[last]
            own = ~np.isnan(r[a:b]).all(axis=0)
            if not own.any() or not known[a:b].any():
                continue
            sigma = np.nanstd(r[a:b][:, own], axis=0)
            sigma = np.where(sigma > 1e-12, sigma, 1.0)
            g = sum(m[0] for m in blocks[first:last])[np.ix_(own, own)] / np.outer(sigma, sigma)
            c = sum(m[1] for m in blocks[first:last])[own] / sigma
            own_y = y[a:b][known[a:b]]
            m = registry.Moments(g, c, sum(m[2] for m in blocks[first:last]), len(own_y), cardinality)
            assets = np.array(names, dtype=object)[own]
            deviation = dict(zip(assets, sigma.tolist(), strict=True))
            for row in _fits_of(chosen, m, float(((own_y - own_y.mean()) ** 2).sum()), assets, fractions, lams):
                held = [{"asset": w["asset"], "sigma": deviation[w["asset"]]} for w in row[-2]]
                out.append((key[0], p["rebal_dt"], *row, held, list(assets)))
        return pd.DataFrame(out, columns=["universe", "rebal_dt", *COLUMNS, "sigmas", "assets"])

    dates = rolled_dates(returns, benchmark, plan, lookback, chunk)
    return dates.groupBy("universe", "chunk").applyInPandas(run, f"universe {kinds['universe']}, rebal_dt {dict(plan.dtypes)['rebal_dt']}, {ROLLED}")


def fit_weights(fits: DataFrame, by: list[str]) -> DataFrame:
    """(by, asset, w) of the fits' weights; only those that are not zero."""
    return fits.select(*by, F.inline("weights"))


def convergence(fits: DataFrame, by: list[str]) -> DataFrame:
    """The residuals and objective of every 25th step and the last one."""
    return fits.select(*by, F.inline("trace"))


def objective(windows: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """rss and the penalized objective of weights (by, lam, asset, w), from the data."""
    base = [c for c in by if c in windows.columns]
    fitted = windows.join(weights, [*base, "asset"]).groupBy(*by, "dt").agg(F.sum(F.col("x") * F.col("w")).alias("fitted"))
    truth = windows.select(*base, "dt", "y").distinct()
    every = weights.select(*by, "lam").distinct().join(truth, base)
    res = every.join(fitted, [*by, "dt"], "left").withColumn("e", F.col("y") - F.coalesce("fitted", F.lit(0.0)))
    total = weights.groupBy(*by).agg(F.sum("w").alias("w_sum"))
    rss = res.groupBy(*by, "lam").agg(F.sum(F.col("e") * F.col("e")).alias("rss"))
    return rss.join(total, by).select(*by, "rss", (0.5 * F.col("rss") + F.col("lam") * F.col("w_sum")).alias("objective"))


def kkt(windows: DataFrame, fits: DataFrame, by: list[str], base: list[str] = WINDOW, eps: float = 1e-6) -> DataFrame:
    """Whether each fit is optimal, judged from the data: with s = x'(Xw - y) + lam, |s| <= eps where w > 0 and s >= -eps elsewhere."""
    w = fit_weights(fits, by)
    fitted = windows.join(w, [*base, "asset"]).groupBy(*by, "dt").agg(F.sum(F.col("x") * F.col("w")).alias("fitted"))
    every = fits.select(*by, "lam", "lam_max").join(windows.select(*base, "dt", "y").distinct(), base)
    res = every.join(fitted, [*by, "dt"], "left").withColumn("e", F.coalesce("fitted", F.lit(0.0)) - F.col("y"))
    slope = res.join(windows.select(*base, "dt", "asset", "x"), [*base, "dt"]).groupBy(*by, "lam", "lam_max", "asset").agg(F.sum(F.col("x") * F.col("e")).alias("s"))
    s, tol = F.col("s") + F.col("lam"), eps * F.greatest(F.lit(1.0), F.col("lam_max"))
    good = F.when(F.col("w") > 0, F.abs(s) <= tol).otherwise(s >= -tol)
    return slope.join(w, [*by, "asset"], "left").groupBy(*by).agg(F.bool_and(good).alias("optimal"), F.count(F.lit(1)).alias("n_assets"))


def first_nonempty(fits: DataFrame, by: list[str], ladder: tuple[float, ...]) -> DataFrame:
    """The first penalty of ``ladder`` (as lam_idx in order) whose fit has any weight; groups without one are dropped."""
    cols = [c for c in fits.columns if c not in by]
    return fits.filter(F.col("nnz") > 0).groupBy(*by).agg(F.min_by(F.struct(*cols), "lam_idx").alias("s")).select(*by, "s.*")


def score_path(fits: DataFrame, gamma: float | None = None) -> DataFrame:
    """Fits with BIC, or EBIC for a ``gamma``, as score."""
    from .moments import bic, ebic

    n, rss, k, p = (F.col(c) for c in ("n", "rss", "nnz", "p"))
    score: Column = bic(n, rss, k) if gamma is None else ebic(n, rss, k, p, gamma)
    return fits.withColumn("score", score)


PATH = "step int, lam double, lam_max double, n long, p long, nnz long, rss double, objective double, weights array<struct<asset: string, w: double>>"


def l1_paths(windows: DataFrame, by: list[str] = WINDOW, least_frac: float = 0.005) -> DataFrame:
    """One row per breakpoint of a window's whole path: by, step (0 at the largest useful penalty), lam, the fit at it.

    Weights are straight lines in the penalty between breakpoints, so these rows hold the fits of all penalties from the largest useful one down to ``least_frac`` of it: see
    :func:`at_penalties`. A window is a group, as in :func:`fit_windows`; its path has a few breakpoints per asset.
    """
    ship(windows.sparkSession)
    kinds = dict(windows.dtypes)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="dt", columns="asset", values="x").sort_index()
        x, assets = np.nan_to_num(wide.to_numpy(dtype=float)), wide.columns.to_numpy()
        y = rows.groupby("dt")["y"].first().sort_index().to_numpy(dtype=float)
        g, c = x.T @ x, x.T @ y
        top = max(float(c.max()), 1e-10)
        out = []
        for k, (lam, w) in enumerate(zip(*kernels.l1_path(g, c, least_frac * top), strict=True)):
            rss = float(((y - x @ w) ** 2).sum())
            chosen = np.flatnonzero(w > 0)
            out.append((*key, k, lam, top, len(y), len(c), len(chosen), rss, 0.5 * rss + lam * float(w.sum()), [{"asset": assets[j], "w": float(w[j])} for j in chosen]))
        return pd.DataFrame(out, columns=[*by, "step", "lam", "lam_max", "n", "p", "nnz", "rss", "objective", "weights"])

    return windows.select(*by, "dt", "asset", "x", "y").groupBy(*by).applyInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], PATH]))


def at_penalties(paths: DataFrame, fractions: tuple[float, ...] = FRACTIONS, by: list[str] = WINDOW) -> DataFrame:
    """(by, lam_idx, lam_frac, lam, weights) at any penalties, read off the breakpoints of :func:`l1_paths` without a further fit.

    A penalty lies between two breakpoints, and its weights are the mean of theirs in proportion. Above the first one there are none; a penalty below the last one is refused with a null ``weights``.
    """
    steps = paths.groupBy(*by).agg(F.first("lam_max").alias("lam_max"), F.sort_array(F.collect_list(F.struct("step", "lam", "weights"))).alias("s"))
    rows = steps.select(*by, "lam_max", "s", F.posexplode(F.array(*map(F.lit, fractions))).alias("lam_idx", "lam_frac")).withColumn("lam", F.col("lam_frac") * F.col("lam_max"))
    # the first breakpoint that is not above the penalty, and the last one that is
    rows = rows.withColumns({"below": F.expr("get(filter(s, x -> x.lam <= lam * (1 + 1e-12)), 0)"), "above": F.expr("try_element_at(filter(s, x -> x.lam > lam * (1 + 1e-12)), -1)")})
    rows = rows.withColumn("part", F.when(F.col("above").isNull(), 1.0).otherwise((F.col("above.lam") - F.col("lam")) / (F.col("above.lam") - F.col("below.lam"))))
    share = lambda side, part: F.transform(F.coalesce(F.col(f"{side}.weights"), F.array().cast("array<struct<asset: string, w: double>>")), lambda x: F.struct(x["asset"].alias("asset"), (x["w"] * part).alias("w")))
    both = F.concat(share("below", F.col("part")), share("above", 1 - F.col("part")))
    names = F.array_sort(F.array_distinct(F.transform("both", lambda x: x["asset"])))
    total = lambda a: F.aggregate(F.filter("both", lambda x: x["asset"] == a), F.lit(0.0), lambda acc, x: acc + x["w"])
    weights = F.filter(F.transform(names, lambda a: F.struct(a.alias("asset"), total(a).alias("w"))), lambda x: x["w"] > 0)
    rows = rows.withColumn("both", both)
    return rows.select(*by, "lam_idx", "lam_frac", "lam", F.when(F.col("below").isNotNull(), weights).alias("weights"))
