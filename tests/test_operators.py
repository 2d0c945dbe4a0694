"""Closed forms and invariants of the operators, on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import kernels
from basketry.operators import accounting, fit, moments, panel, risk, rules, schedule

RNG = np.random.default_rng(7)
DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]


def market(n=6, days=60, seed=3):
    r = np.random.default_rng(seed).normal(0.0005, 0.01, (days, n))
    return r, r @ np.full(n, 1 / n)


def long(spark, r, names=None):
    names = names or [f"S{i:02d}" for i in range(r.shape[1])]
    rows = [("U", DAYS[t], names[i], float(r[t, i])) for t in range(len(r)) for i in range(r.shape[1])]
    return spark.createDataFrame(rows, "universe string, dt date, asset string, r double")


def test_kernels_agree_and_satisfy_kkt():
    x = RNG.normal(size=(80, 40))
    true = np.zeros(40)
    true[:6] = RNG.uniform(0.5, 1.5, 6)
    y = x @ true + 0.01 * RNG.normal(size=80)
    g, c = x.T @ x, x.T @ y
    lam = 0.01 * c.max()
    fits = [kernels.fit_l1(g, c, lam, a)[0] for a in kernels.ALGORITHMS]
    for w in fits:
        s = g @ w - c + lam
        assert np.all(w >= 0) and np.all(np.abs(s[w > 0]) < 1e-6) and np.all(s[w == 0] > -1e-6)
        assert np.allclose(w, fits[0], atol=1e-6)
    assert set(np.flatnonzero(fits[0] > 1e-3)) >= set(range(6))


def test_kernel_edges():
    x = RNG.normal(size=(30, 8))
    x[:, 1] = x[:, 0]  # collinear
    y = x[:, 0] + 0.1 * x[:, 2]
    g, c = x.T @ x, x.T @ y
    w = kernels.fit_l1(g, c, 0.0)[0]
    assert np.linalg.norm(x @ w - y) < 1e-5
    assert not kernels.fit_l1(g, c, c.max())[0].any()
    assert np.count_nonzero(kernels.fit_omp(g, c, float(y @ y), 2)[0]) <= 2
    with pytest.raises(ValueError):
        kernels.fit_omp(g, c, 1.0, 0)


def test_reweighted_against_a_loop_of_plain_fits():
    x = RNG.normal(size=(60, 12)) / 8
    y = x[:, :4] @ np.array([1.0, 0.5, 0.2, 0.05]) + 0.02 * RNG.normal(size=60)
    g, c = x.T @ x, x.T @ y
    for lam in (1e-4, 1e-3, 0.05 * c.max()):
        penalty, before = np.full(12, lam), None
        for _ in range(5):
            w = np.zeros(12)
            for _ in range(4000):  # cyclic descent
                for j in range(12):
                    w[j] = max(0.0, (c[j] - penalty[j] - g[j] @ w + g[j, j] * w[j]) / g[j, j])
            support = w > 1e-8
            if before is not None and np.array_equal(support, before):
                break
            before, penalty = support, lam / (w + 1e-3)
        assert kernels.fit_reweighted(g, c, lam)[0] == pytest.approx(w, abs=1e-7)
        relative = kernels.fit_reweighted(g, c, lam, relative=True)[0]
        assert relative.any() and np.count_nonzero(relative) <= np.count_nonzero(kernels.fit_l1(g, c, lam)[0])


def test_test_curve_goes_on_from_train(spark):
    from basketry.operators import accounting

    rows = [("u", "train", 1, 0.1, 0.2), ("u", "train", 2, 0.1, 0.0), ("u", "test", 3, -0.5, 1.0), ("v", "test", 3, 0.5, 0.5)]
    got = accounting.chained(spark.createDataFrame(rows, "universe string, split string, dt int, p double, b double"), ["universe"]).orderBy("universe", "dt").collect()
    assert [r["portfolio"] for r in got] == pytest.approx([1.1, 1.21, 0.605, 1.5])
    assert [r["benchmark"] for r in got] == pytest.approx([1.2, 1.2, 2.4, 1.5])


def test_grouped_fit_matches_kernel_and_drops_nothing(spark):
    r, y = market()
    rows = panel.align(long(spark, r), spark.createDataFrame([("U", DAYS[t], float(y[t])) for t in range(60)], "universe string, dt date, r double"))
    x = panel.standardize(rows)
    fits = fit.fit_windows(x, ("fista",), (0.1, 2.0), by=["universe"]).orderBy("lam_idx").collect()
    assert [f["nnz"] > 0 for f in fits] == [True, False]
    z = (r - r.mean(0)) / r.std(0)
    w = kernels.fit_l1(z.T @ z, z.T @ y, 0.1 * (z.T @ y).max())[0]
    assert {a["asset"]: pytest.approx(a["w"], abs=1e-9) for a in fits[0]["weights"]} == {f"S{i:02d}": w[i] for i in np.flatnonzero(w > 0)}


def test_nav_equals_a_day_loop(spark):
    r, _ = market(5)
    names = [f"S{i:02d}" for i in range(5)]
    targets = {10: [0.5, 0.5, 0, 0, 0], 25: [0, 0.2, 0.8, 0, 0], 40: [0.25, 0.25, 0.25, 0.25, 0]}
    w = spark.createDataFrame([("U", "m", DAYS[k], names[i], float(v)) for k, ws in targets.items() for i, v in enumerate(ws) if v], "universe string, method string, rebal_dt date, asset string, w double")
    cash = spark.createDataFrame([("U", d, 1e-4) for d in DAYS], "universe string, dt date, cash double")
    got = accounting.walk(w, long(spark, r), cash, accounting.linear_cost(10), 1000.0)
    nav = [x["nav"] for x in got["nav"].orderBy("dt").collect()]
    book, value, want, costs, turn, before = np.zeros(5), 1000.0, [], [], [], np.zeros(5)
    for t in range(60):
        if t in targets:
            new = np.array(targets[t], dtype=float)
            cost = 1e-3 * np.abs(new - book).sum() * value
            costs.append(cost)
            turn.append(0.5 * np.abs(new - before).sum())
            before, value, book = new, value - cost, new.copy()
        if book.any():
            value *= 1 + book @ r[t]
            book = book * (1 + r[t])
            book /= book.sum()
        else:
            value *= 1 + 1e-4
        want.append(value)
    assert nav == pytest.approx(want, rel=1e-12)
    reb = got["rebalances"].orderBy("rebal_dt").collect()
    assert [x["cost"] for x in reb] == pytest.approx(costs, rel=1e-9)
    assert [x["turnover"] for x in reb] == pytest.approx(turn, rel=1e-9)


def test_costs_reject_negatives():
    for bad in (lambda: accounting.linear_cost(-1), lambda: accounting.sqrt_impact_cost(-1, 1, 1)):
        with pytest.raises(ValueError):
            bad()


def test_drawdown_and_undefined_ratios(spark):
    nav = spark.createDataFrame([("U", "m", DAYS[i], v) for i, v in enumerate([100.0, 120.0, 60.0, 90.0])], "universe string, method string, dt date, nav double")
    assert risk.drawdown_stats(nav, ["universe", "method"]).first()["max_drawdown"] == pytest.approx(-0.5)
    flat = spark.createDataFrame([("U", DAYS[i], 0.0, 0.0) for i in range(5)], "universe string, dt date, p double, b double")
    x = risk.risk_core(flat, ["universe"]).first()
    assert x["sharpe"] is None and x["sortino"] is None and x["information_ratio"] is None
    assert risk.capm(flat, ["universe"]).first()["beta"] is None


def test_newey_west_against_plain_formula():
    x = np.column_stack([np.ones(50), RNG.normal(size=(50, 3))])
    y = x @ [0.1, 1, 2, 3] + RNG.normal(size=50)
    beta, t = risk.newey_west(x, y, 0)
    e = y - x @ beta
    inv = np.linalg.inv(x.T @ x)
    assert t == pytest.approx(beta / np.sqrt(np.diag(inv @ (x.T * e**2) @ x @ inv)))
    meat = sum(max(0.0, 1 - abs(i - j) / 4) * e[i] * e[j] * np.outer(x[i], x[j]) for i in range(50) for j in range(50))
    assert risk.newey_west(x, y, 3)[1] == pytest.approx(beta / np.sqrt(np.diag(inv @ meat @ inv)))


def test_ff3_recovers_betas(spark):
    f = RNG.normal(0, 0.01, (60, 3))
    p = 0.0001 + f @ [1.1, -0.4, 0.3]
    rows = spark.createDataFrame([("U", DAYS[i], float(p[i]), *map(float, f[i]), 0.0) for i in range(60)], "universe string, dt date, p double, mkt_rf double, smb double, hml double, rf double")
    x = risk.ff3(rows, ["universe"]).first()
    assert (x["beta_mkt_rf"], x["beta_smb"], x["beta_hml"], x["r2"]) == pytest.approx((1.1, -0.4, 0.3, 1.0))
    assert risk.ff3_rolling(rows, ["universe"], 30).filter("beta_smb is null").count() == 29


def test_simplex_and_fallback(spark):
    w = spark.createDataFrame([("U", 1, "a", 0.6), ("U", 1, "b", 0.00001), ("U", 2, "a", 0.0)], "universe string, k int, asset string, w double")
    assets = spark.createDataFrame([("U", "a"), ("U", "b")], "universe string, asset string")
    got = {(x["k"], x["asset"]): x["w"] for x in rules.to_simplex(w, ["universe", "k"], universe=assets).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): 0.5, (2, "b"): 0.5}


def test_caps_ineligible_and_clipped(spark):
    caps = spark.createDataFrame([("U", "a", 3.0), ("U", "b", None), ("U", "c", float("nan")), ("U", "d", -1.0), ("U", "e", 1.0)], "universe string, asset string, cap double")
    assert {x["asset"]: x["w"] for x in rules.top_n_cap(caps, 9, ["universe"]).collect()} == {"a": 0.75, "e": 0.25}


def test_forward_fill_is_limited_in_rows(spark):
    dates = spark.createDataFrame([("U", d) for d in DAYS[:8]], "universe string, dt date")
    factors = spark.createDataFrame([(DAYS[1], 1.0)], "dt date, mkt_rf double")
    assert [x["dt"] for x in schedule.align_factors(dates, factors, ["mkt_rf"]).orderBy("dt").collect()] == DAYS[1:5]


def test_lambda_selection_takes_the_first_tie(spark):
    path = spark.createDataFrame([("U", 0, 2.0, 5.0), ("U", 1, 1.0, 5.0), ("U", 2, 0.5, None)], "universe string, lam_idx int, lam double, score double")
    assert moments.select_lambda(path, ["universe"]).first()["lam_idx"] == 0


def test_bic_values(spark):
    n, rss, k = F.lit(100), F.lit(2.0), F.lit(3)
    x = spark.range(1).select(moments.bic(n, rss, k).alias("b"), moments.ebic(n, rss, k, F.lit(50), 1.0).alias("e"), moments.bic(n, F.lit(0.0), k).alias("z")).first()
    assert x["b"] == pytest.approx(100 * np.log(0.02) + 3 * np.log(100))
    assert x["e"] == pytest.approx(x["b"] + 6 * np.log(50)) and x["z"] == float("-inf")
    with pytest.raises(ValueError):
        moments.ebic(n, rss, k, k, 2)
