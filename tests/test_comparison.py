"""Fits and rules on one split: training dates alone decide, and every method, penalty and regime has its metrics."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import compare
from basketry.plans import queries as core

SF = "/root/testdata/sf0.01"


def rows_of(spark, r, y, n_train):
    rows = [("U", dt.date(2020, 1, 1) + dt.timedelta(days=t), f"S{i}", float(r[t, i]), float(y[t]), "train" if t < n_train else "test") for t in range(len(r)) for i in range(r.shape[1])]
    return spark.createDataFrame(rows, "universe string, dt date, asset string, r double, y double, split string")


def test_split_fit_uses_training_dates_only(spark):
    r = np.random.default_rng(5).normal(0.0005, 0.01, (60, 6))
    y = r[:, :3].mean(axis=1)
    changed = np.vstack([r[:40], -3 * r[40:]])
    fits, w = compare.split_fit(rows_of(spark, r, y, 40), ("admm", "omp"), (0.05, 0.5), 3)
    _, again = compare.split_fit(rows_of(spark, changed, y, 40), ("admm", "omp"), (0.05, 0.5), 3)
    got = {(x["method"], x["lam_idx"], x["asset"]): x["w"] for x in w.collect()}
    assert got == pytest.approx({(x["method"], x["lam_idx"], x["asset"]): x["w"] for x in again.collect()})
    assert fits.count() == 3 and sum(v for k, v in got.items() if k[0] == "omp") == pytest.approx(1)
    assert {k[2] for k in got if k[0] == "omp"} == {"S0", "S1", "S2"}
    first, chosen = compare.ladder_fit(rows_of(spark, r, y, 40), ("admm",), (1.5, 0.05))
    assert [x["lam_idx"] for x in first.collect()] == [1] and chosen.count() >= 3


def test_method_comparison_has_rules_and_fits(spark):
    rows = core.queries()["method_comparison_all"](spark, SF).collect()
    by = {}
    for x in rows:
        by.setdefault(x["universe"], {})[x["method"]] = x
    assert by and all({"cap", "equal", "fista", "cd", "admm", "omp"} <= set(m) for m in by.values())
    t = core.Tables(spark, SF)
    tt = t.train_test().toPandas()
    caps = t.prices("month").toPandas().merge(tt[tt.split == "train"][["universe", "dt", "asset"]]).groupby(["universe", "asset"])["cap"].sum()
    for u, m in by.items():
        top = caps[u].reset_index().sort_values(["cap", "asset"], ascending=[False, True]).head(10).set_index("asset")["cap"]
        test = tt[(tt.universe == u) & (tt.split == "test")].pivot(index="dt", columns="asset", values="r")[top.index]
        b = tt[(tt.universe == u) & (tt.split == "test")].groupby("dt")["y"].first()
        gap = test.to_numpy() @ (top / top.sum()).to_numpy() - b.to_numpy()
        assert m["cap"]["te"] == pytest.approx(gap.std(ddof=1) * 12**0.5, abs=2e-6)


def test_lambda_path_has_every_penalty(spark):
    rows = core.queries()["lambda_path"](spark, SF).collect()
    assert rows and all(x["oos_te"] is not None for x in rows if x["n_active"])
    for u in {x["universe"] for x in rows}:
        path = sorted((x["lam_idx"], x["objective"], x["in_sample_r2"]) for x in rows if x["universe"] == u)
        assert [x[0] for x in path] == list(range(12)) and all(a[1] <= b[1] + 1e-12 for a, b in zip(path, path[1:]))


def test_regimes_are_split_and_fitted_one_by_one(spark):
    t = core.Tables(spark, SF)
    dates = core._regime_split(t).select("universe", "split", "dt").distinct().groupBy("universe").pivot("split", ["train", "test"]).agg(F.count("dt").alias("n"), F.max("dt").alias("hi"), F.min("dt").alias("lo")).collect()
    assert dates and all((x["train_n"], x["test_n"]) == (20, 10) and x["train_hi"] < x["test_lo"] for x in dates)
    rows = core.queries()["regime_fits"](spark, SF).collect()
    assert len({(x["universe"], x["regime"]) for x in rows if x["method"] == "cap"}) == len(dates)
    assert {"admm", "omp", "fista"} <= {x["method"] for x in rows} and all((x["n_train"], x["n_test"]) == (20, 10) for x in rows)
