"""Fits on tables, for universes with more assets than a task can hold.

``rows``: by (one column), dt, asset, x and y. Products with a residual are made asset by asset (from its series in one row, or by an aggregation), so every asset is looked at without ever meeting another one; a task
holds only the assets that a fit is about to use: a working set, or the greedy fit's own choices. Steps are written by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import ship


@dataclass
class WideFit:
    """``weights``: by, asset, lam, w (above 0). ``report``: by, violation, optimal, gap. ``log``: per round the assets that are still candidates, and the rows that each of its passes reads."""

    weights: DataFrame
    report: DataFrame
    log: list[dict]


def _products(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(by, "asset").agg(F.sum(F.col("x") * F.col(value)).alias(name))


def _along(at: str, x: str, e: str) -> Column:
    """The product of a series, given by places and values, with a vector. Its order of summation is fixed."""
    return F.aggregate(F.zip_with(at, x, lambda i, v: F.coalesce(v * F.get(F.col(e), i), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)


def _inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.coalesce(u * v, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def series(rows: DataFrame, keep, by: str = "universe") -> tuple[DataFrame, DataFrame]:
    """(by, y, lam_max): y in order of dates and the largest useful penalty. (by, asset, at, x, c, norm, n, kind): one row an asset, with the places and values of its dates, c = x'y, norm = |x|,
    n its rows, and kind, equal for assets with one direction."""
    order = Window.partitionBy(by).orderBy("dt")  # one row per date
    dates = keep(rows.groupBy(by, "dt").agg(F.first("y").alias("y")).withColumn("i", F.row_number().over(order) - 1))
    truth = dates.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y"))), lambda d: d["y"]).alias("y"))
    cells = rows.join(dates.select(by, "dt", "i"), [by, "dt"]).groupBy(by, "asset").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("cells"), F.count(F.lit(1)).alias("n"))
    own = cells.select(by, "asset", F.col("cells.i").alias("at"), F.col("cells.x").alias("x"), "n").withColumn("norm", F.sqrt(_inner("x", "x")))
    kind = F.xxhash64("at", F.transform("x", lambda v: F.round(v / F.greatest("norm", F.lit(1e-300)), 9)))
    assets = keep(own.withColumn("kind", kind).join(truth, by).withColumn("c", _along("at", "x", "y")).drop("y"))
    return keep(truth.join(assets.groupBy(by).agg(F.greatest(F.max("c"), F.lit(1e-10)).alias("lam_max")), by)), assets


def wide_fit(rows: DataFrame, lam_frac: float, keep, by: str = "universe", add: int = 100, eps: float = 1e-7, rounds: int = 50, each: DataFrame | None = None, start: DataFrame | None = None, screen: bool = True) -> WideFit:
    """min 1/2 |Xw - y|^2 + sum(lam_j w_j) over w >= 0, where lam is ``lam_frac`` of the largest useful penalty, or ``each`` (by, asset, lam) of its own.

    An active-set search on tables: one task per universe solves exactly for the assets of its working set and gives the residual e = y - Xw; an asset's whole series is one row, so a scan gives the
    products x'e of all assets, without a shuffle, and every asset is judged. Those that exceed their penalty most (``add`` of them, and of assets with one direction the first only, as its copies then gain nothing)
    join the assets with weights. The objective falls in every round, so no working set comes back. A working set holds as many assets as there are dates, and ``add`` more; ``start`` (by, asset) joins the
    first one.

    Screening is safe: theta = s e, with the largest s <= 1 that keeps x'theta <= lam for all assets, is a point of the dual problem, whose optimum lies within sqrt(2 gap) of
    it. An asset with x'theta + |x| sqrt(2 gap) < lam has weight 0 at the optimum and does not join: as soon as half of the rows are gone, the rest is written anew, and the others are never read again.

    It ends when nobody exceeds a penalty by more than ``eps`` of the largest one, and then the fit is the minimizer over all assets; if that takes more than ``rounds``, it raises.
    """
    ship(rows.sparkSession)
    return _fit(*series(rows, keep, by), lam_frac, keep, by, add, eps, rounds, each, start, screen)


def _fit(universes: DataFrame, assets: DataFrame, lam_frac: float, keep, by: str, add: int = 100, eps: float = 1e-7, rounds: int = 50, each: DataFrame | None = None, start: DataFrame | None = None, screen: bool = True) -> WideFit:
    """:func:`wide_fit` on the tables of :func:`series`."""
    kind, name = dict(assets.dtypes)[by], dict(assets.dtypes)["asset"]
    lam = each.select(by, "asset", "lam") if each is not None else universes.select(by, (lam_frac * F.col("lam_max")).alias("lam"))
    data = keep(assets.select(by, "asset", "at", "x", "norm", "n", "kind").join(lam, [by, "asset"] if each is not None else by))

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("asset")
        y, lam = np.nan_to_num(np.asarray(part["y"].iloc[0], dtype=float)), part["lam"].to_numpy(dtype=float)
        x = np.zeros((len(y), len(part)))
        for j, (at, values) in enumerate(zip(part["at"], part["x"], strict=True)):
            x[at, j] = np.nan_to_num(np.asarray(values, dtype=float))
        d = x.T @ y - lam
        w = kernels.active_set(x.T @ x, d, np.zeros(len(d)), 1e-12 * max(1e-10, float(np.abs(d).max())))
        held = [{"asset": part["asset"].iloc[j], "w": float(w[j])} for j in np.flatnonzero(w > 0)]
        return pd.DataFrame({by: [key[0]], "e": [(y - x @ w).tolist()], "price": [float(lam @ w)], "held": [held]})

    shape = f"{by} {kind}, e array<double>, price double, held array<struct<asset: {name}, w: double>>"
    state = universes.select(by, "y", "lam_max", F.col("y").alias("e"), F.lit(0.0).alias("price"), F.array().cast(f"array<struct<asset: {name}, w: double>>").alias("held"))
    order = Window.partitionBy(by).orderBy("worst")
    log = []
    for step in range(rounds + 1):
        scale = data.join(state.select(by, "e"), by).withColumn("corr", _along("at", "x", "e")).filter("corr > 0").groupBy(by).agg(F.least(F.lit(1.0), F.min(F.col("lam") / F.col("corr"))).alias("s"))
        ye, ee, s = _inner("y", "e"), _inner("e", "e"), F.coalesce("s", F.lit(1.0))
        found = keep(state.join(scale, by, "left").select(by, "lam_max", "e", s.alias("s"), F.greatest(ee / 2 + F.col("price") - (s * ye - s * s * ee / 2), F.lit(0.0)).alias("gap")))
        radius = F.sqrt(2 * F.col("gap")) * (1 + 1e-9) + 1e-12
        safe = F.col("s") * F.col("corr") + F.col("norm") * radius >= F.col("lam") * (1 - 1e-9) if screen else F.lit(True)
        seen = data.join(found, by).withColumn("corr", _along("at", "x", "e")).withColumns({"over": F.col("corr") - F.col("lam"), "live": safe})
        worst = F.col("live") & (F.col("over") > eps * F.col("lam_max"))
        left = seen.agg(F.count_if("live").alias("assets"), F.coalesce(F.sum(F.when(F.col("live"), F.col("n"))), F.lit(0)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("held"), F.count_if(worst).alias("worst")).first()
        if not left["worst"]:
            break
        if step == rounds:
            raise RuntimeError(f"no optimum within {rounds} rounds")
        halved = 2 * left["rows"] <= left["held"]
        log.append({"round": step, "candidates": left["assets"], "rows": left["rows"] if halved else left["held"]})
        first = F.struct((-F.round(F.col("over") / F.col("lam_max"), 12)).alias("by"), "asset")
        ranked = seen.filter(worst).groupBy(by, "kind").agg(F.min(first).alias("worst")).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= add)
        working = ranked.select(by, "worst.asset").unionByName(state.select(by, F.inline("held")).select(by, "asset"))
        if step == 0 and start is not None:
            working = working.unionByName(start.select(by, "asset"))
        if halved:
            data = keep(seen.filter("live").select(*data.columns))
        part = data.join(working.distinct(), [by, "asset"]).join(universes.select(by, "y"), by).select(by, "asset", "at", "x", "lam", "y")
        fits = keep(part.groupBy(by).applyInPandas(run, shape))
        state = universes.join(fits, by, "left").select(by, "y", "lam_max", *[F.coalesce(fits[c], o).alias(c) for c, o in (("e", F.col("y")), ("price", F.lit(0.0)), ("held", F.array()))])
    w = state.select(by, F.inline("held"))
    off = seen.join(w, [by, "asset"], "left").filter("live or w > 0")
    over = F.when(F.col("w") > 0, F.abs("over")).otherwise(F.greatest("over", F.lit(0.0))) / F.col("lam_max")
    report = found.select(by, "gap").join(off.groupBy(by).agg(F.max(over).alias("violation")), by, "left")
    report = report.select(by, F.coalesce("violation", F.lit(0.0)).alias("violation"), "gap").withColumn("optimal", F.col("violation") <= eps)
    return WideFit(w.join(data.select(by, "asset", "lam"), [by, "asset"]).select(by, "asset", "lam", "w"), report, log)


def wide_reweighted(rows: DataFrame, lam_frac: float, keep, by: str = "universe", rounds: int = 5, epsilon: float = 1e-3, **how) -> tuple[DataFrame, DataFrame]:
    """(weights, supports): up to ``rounds`` wide fits, each with the penalties lam / (w + epsilon) of the weights before it.

    A universe is done when its support (weights above 1e-8) is that of the round before, and is not read again. ``supports``: by, round, n_active, changed (assets that came or went).
    """
    ship(rows.sparkSession)
    key = dict(rows.dtypes)[by]
    bounds, own = series(rows, keep, by)
    assets = own.select(by, "asset").join(bounds.select(by, (lam_frac * F.col("lam_max")).alias("lam")), by)
    first = _fit(bounds, own, lam_frac, keep, by, **how)
    w = keep(first.weights.select(by, "asset", "w"))
    done = keep(w.filter("false"))
    supports = keep(bounds.select(by).join(w.filter("w > 1e-8").groupBy(by).agg(F.count(F.lit(1)).alias("n_active")), by, "left").select(by, F.lit(0).alias("round"), F.coalesce("n_active", F.lit(0)).alias("n_active"), F.lit(None).cast("long").alias("changed")))
    going = keep(bounds.select(by))
    for k in range(1, rounds):
        lam = (F.col("lam") / (F.coalesce("w", F.lit(0.0)) + epsilon)).alias("lam")
        each = keep(assets.join(going, by, "left_semi").join(w, [by, "asset"], "left").select(by, "asset", lam))
        part = [t.join(going, by, "left_semi") for t in (bounds, own)]
        new = keep(_fit(*part, lam_frac, keep, by, each=each, start=w, **how).weights.select(by, "asset", "w"))
        old_s, new_s = (x.filter("w > 1e-8").select(by, "asset", F.lit(1).alias(n)) for x, n in ((w, "old"), (new, "new")))
        moves = old_s.join(new_s, [by, "asset"], "full").groupBy(by).agg(F.count("new").alias("n_active"), F.count_if(F.col("old").isNull() | F.col("new").isNull()).alias("changed"))
        moves = keep(going.join(moves, by, "left").select(by, F.lit(k).alias("round"), F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("changed", F.lit(0)).alias("changed")))
        supports = supports.unionByName(moves)
        still = moves.filter("changed = 0").select(F.col(by).cast(key).alias(by))
        done = done.unionByName(new.join(still, by, "left_semi"))
        going = keep(going.join(still, by, "left_anti"))
        w = keep(new.join(going, by, "left_semi"))
        if going.isEmpty():
            break
    return keep(done.unionByName(w)), supports


STATE = "struct<assets: array<string>, w: array<double>, gram: array<array<double>>, factor: array<array<double>>, c: array<double>, rss: double>"


def _grown(states: pa.Array, assets: pa.Array, products: pa.Array, own: pa.Array, cs: pa.Array, yys: pa.Array) -> pa.Array:
    """Each universe's state with one asset more."""

    def one(s, asset, found, norm2, c_new, yy):
        s = s or {"assets": [], "gram": [], "factor": [], "c": [], "w": []}
        along = dict(found or [])
        column = [along.get(a, 0.0) for a in s["assets"]]
        w, gram, factor, c = kernels.grown_fit(s["gram"], s["factor"], s["c"], s["w"], column, norm2, c_new)
        rss = float(yy - 2 * np.dot(c, w) + w @ np.array(gram) @ w)
        return {"assets": [*s["assets"], asset], "w": w.tolist(), "gram": gram, "factor": factor, "c": c, "rss": max(rss, 0.0)}

    rows = [one(*r) for r in zip(*(a.to_pylist() for a in (states, assets, products, own, cs, yys)), strict=True)]
    square = pa.list_(pa.list_(pa.float64()))
    return pa.array(rows, pa.struct([("assets", pa.list_(pa.string())), ("w", pa.list_(pa.float64())), ("gram", square), ("factor", square), ("c", pa.list_(pa.float64())), ("rss", pa.float64())]))


def wide_greedy(rows: DataFrame, k: int, keep, by: str = "universe", least: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(weights, steps) of the greedy fit: the asset of the largest product with the residual joins, and the chosen ones are refitted over w >= 0, up to ``k`` assets.

    A step reads the rows twice: one aggregation by asset for the products x'e of all assets, and the rows of the assets that join. What a universe keeps is one row of its chosen assets:
    their Gram matrix, its Cholesky factor, which grows by one row (one forward substitution, no refit from zero), and the weights. Where the factor's solution is negative, or an
    asset depends on those before it, the least squares over w >= 0 are solved from the Gram matrix. A universe ends early where no product exceeds ``least``. Ties go to the first asset by name.
    ``steps``: by, iter, asset, rss, left (the largest product of any asset after the step).
    """
    if k < 1:
        raise ValueError("k must be positive")
    ship(rows.sparkSession)
    truth = keep(rows.groupBy(by, "dt").agg(F.first("y").alias("y")))
    yy = keep(truth.groupBy(by).agg(F.sum(F.col("y") * F.col("y")).alias("yy")))
    corr = keep(_products(rows, by, "y", "corr"))
    state, held, steps = None, None, None
    grow = F.arrow_udf(_grown, STATE)
    for step in range(1, k + 1):
        free = corr if held is None else corr.join(held.select(by, "asset").distinct(), [by, "asset"], "left_anti")
        order = F.struct(-F.col("corr"), F.col("asset"))
        best = keep(free.filter(F.col("corr") > least).groupBy(by).agg(F.min_by(F.struct("asset", "corr"), order).alias("b")).select(by, "b.asset"))
        if best.isEmpty():
            break
        new = keep(rows.join(best, [by, "asset"]).select(by, "dt", "asset", "x", "y"))
        sums = new.groupBy(by).agg(F.first("asset").alias("asset"), F.sum(F.col("x") * F.col("x")).alias("own"), F.sum(F.col("x") * F.col("y")).alias("c")).join(yy, by)
        if held is None:
            joined = sums.withColumns({"products": F.lit(None).cast("array<struct<a: string, g: double>>"), "s": F.lit(None).cast(STATE)})
        else:
            along = held.select(by, "dt", F.col("asset").alias("a"), F.col("x").alias("xa")).join(new.select(by, "dt", "x"), [by, "dt"]).groupBy(by, "a").agg(F.sum(F.col("x") * F.col("xa")).alias("g"))
            products = along.groupBy(by).agg(F.collect_list(F.struct("a", "g")).alias("products"))  # at most k of them
            joined = sums.join(products, by, "left").join(state.select(by, F.struct(*[c for c in state.columns if c != by]).alias("s")), by, "left")
        grown = keep(joined.select(by, grow("s", "asset", F.map_from_entries("products"), "own", "c", "yy").alias("s")).select(by, "s.*"))
        picked = grown.select(by, F.element_at("assets", -1).alias("asset"), "rss")
        state = grown if state is None else keep(grown.unionByName(state.join(grown.select(by), by, "left_anti")))
        held = new if held is None else keep(held.unionByName(new))
        weights = state.select(by, F.inline(F.arrays_zip(F.col("assets").alias("asset"), F.col("w").alias("w"))))
        fitted = held.join(weights, [by, "asset"]).groupBy(by, "dt").agg(F.sum(F.col("x") * F.col("w")).alias("f"))
        e = keep(truth.join(fitted, [by, "dt"], "left").select(by, "dt", (F.col("y") - F.coalesce("f", F.lit(0.0))).alias("e")))
        corr = keep(_products(rows.join(e, [by, "dt"]), by, "e", "corr"))
        left = corr.groupBy(by).agg(F.max("corr").alias("left"))
        made = keep(picked.join(left, by).select(by, F.lit(step).alias("iter"), "asset", "rss", "left"))
        steps = made if steps is None else steps.unionByName(made)
    if state is None:
        kinds = dict(rows.dtypes)
        empty = truth.filter("false")
        return empty.select(by, F.lit("").cast(kinds["asset"]).alias("asset"), F.lit(0.0).alias("w")), empty.select(by, F.lit(0).alias("iter"), F.lit("").alias("asset"), F.lit(0.0).alias("rss"), F.lit(0.0).alias("left"))
    weights = state.select(by, F.inline(F.arrays_zip(F.col("assets").alias("asset"), F.col("w").alias("w"))))
    return weights.filter("w > 0"), steps
