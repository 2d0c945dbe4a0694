"""Rolling fits, the registry of solvers and cost models, rolling regressions and merged quantiles."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import kernels, registry
from basketry.operators import fit, panel, risk, schedule
from basketry.plans import walkforward
from basketry.session import table


def market(spark, n=90, p=7, seed=3, holes=0.0):
    """(returns, benchmark) of two universes; ``holes``: the share of missing returns. One asset starts late, one universe is shorter."""
    rng = np.random.default_rng(seed)
    rows, bench = [], []
    for u, days in (("U", n), ("V", n - 20)):
        r = 0.01 * rng.normal(size=(days, p)) + 0.01 * rng.normal(size=(days, 1))
        y = r @ np.linspace(1, 0, p) / 3 + 0.002 * rng.normal(size=days)
        for t in range(days):
            dt = datetime.date(2020, 1, 1) + datetime.timedelta(days=3 * t)
            bench.append((u, dt, float(y[t])))
            rows += [(u, dt, f"S{j}", float(r[t, j])) for j in range(p) if rng.random() >= holes and not (j == p - 1 and t < 40)]
    schema = "universe string, dt date, {}r double"
    return table(spark.createDataFrame(rows, schema.format("asset string, "))), table(spark.createDataFrame(bench, schema.format("")))


@pytest.mark.parametrize("holes, chunk", [(0.0, 3), (0.2, 2), (0.0, 50)])
def test_rolling_fits_equal_those_of_copied_windows(spark, holes, chunk):
    r, b = market(spark, holes=holes)
    plan = schedule.monthly(r)
    methods = ("fista", "reweighted_relative", "omp")
    new = fit.fit_rolling(r, b, plan, 26, methods, (0.3, 0.05), cardinality=3, chunk=chunk)
    windows = panel.standardize(schedule.train_windows(r, plan, 26), centred=False, by=["universe", "rebal_dt", "asset"])
    old = fit.fit_windows(windows.join(b.withColumnRenamed("r", "y"), ["universe", "dt"]), methods, (0.3, 0.05), cardinality=3)
    key = ["universe", "rebal_dt", "method", "lam_idx"]
    mine, theirs = ({tuple(x[k] for k in key): x for x in d.collect()} for d in (new, old))
    assert mine.keys() == theirs.keys() and len(mine) > 30
    sigma = {(x["universe"], x["rebal_dt"], x["asset"]): x["sigma"] for x in windows.select("universe", "rebal_dt", "asset", "sigma").distinct().collect()}
    for k, x in mine.items():
        y = theirs[k]
        assert (x["n"], x["p"], x["nnz"]) == (y["n"], y["p"], y["nnz"])
        for name in ("lam", "rss", "tss", "objective"):
            assert x[name] == pytest.approx(y[name], rel=1e-8, abs=1e-12)
        assert [w["asset"] for w in x["weights"]] == [w["asset"] for w in y["weights"]]
        assert [w["w"] for w in x["weights"]] == pytest.approx([w["w"] for w in y["weights"]], rel=1e-6, abs=1e-10)
        assert [s["sigma"] for s in x["sigmas"]] == pytest.approx([sigma[k[0], k[1], s["asset"]] for s in x["sigmas"]], rel=1e-9) and len(x["assets"]) == x["p"]


def test_a_date_is_dealt_to_a_chunk_once(spark):
    r, b = market(spark)
    plan = schedule.monthly(r)
    dealt = fit.rolled_dates(r, b, plan, 26, 100)
    assert dealt.groupBy("universe", "pos").count().filter("count > 1").count() == 0
    copies = schedule.train_windows(r, plan, 26).select("universe", "rebal_dt", "dt").distinct().count()
    assert dealt.count() * 2 < copies


def halves(m, lam, start):
    """A solver of the user: equal weights on the assets whose product exceeds half of the largest."""
    w = np.where(m.c > 0.5 * m.c.max(), 1.0, 0.0)
    return w / max(w.sum(), 1.0), 1, True, [(1, 0.0, 0.0, math.nan)]


def test_a_users_solver_and_cost_run_in_a_back_test(spark):
    registry.register_solver("halves", halves, penalised=False)
    registry.register_cost("flat", lambda rate: F.lit(rate))
    r, b = market(spark)
    cash = r.select("universe", "dt").distinct().withColumn("cash", F.lit(0.0))
    config = walkforward.Config(methods=("halves", "omp"), lookback=26, cost="flat", cost_parameters=(("rate", 0.01),))
    out = walkforward.run(r, b, cash, config)
    books = out["weights"].filter("method = 'halves'").groupBy("universe", "rebal_dt").agg(F.sum("w").alias("s"), F.count("w").alias("n")).collect()
    assert len(books) > 5 and all(x["s"] == pytest.approx(1) and x["n"] >= 1 for x in books)
    free = walkforward.run(r, b, cash, walkforward.Config(methods=("halves",), lookback=26, cost="none", cost_parameters=()))
    last = lambda o: {x["universe"]: x["nav"] for x in o["nav"].filter("method = 'halves'").groupBy("universe").agg(F.max_by("nav", "dt").alias("nav")).collect()}
    dear, cheap = last(out), last(free)
    assert all(dear[u] < cheap[u] for u in dear)


def test_the_registry_says_what_is_wrong(spark):
    with pytest.raises(ValueError, match="unknown solver"):
        registry.solver("nobody")
    with pytest.raises(ValueError, match="unknown methods"):
        walkforward.Config(methods=("nobody",))
    with pytest.raises(ValueError, match="is a rule"):
        registry.register_solver("random", halves)
    with pytest.raises(ValueError, match="unknown cost"):
        registry.cost("nothing")
    registry.register_solver("negative", lambda m, lam, start: (-np.ones(len(m.c)), 1, True, []))
    m = registry.Moments(np.eye(2), np.ones(2), 1.0, 2, 1)
    with pytest.raises(ValueError, match="finite numbers"):
        registry.solver("negative").weights(m, 0.1, None)
    assert registry.solver("cd").weights(m, 0.5, None)[0] == pytest.approx(kernels.fit_l1(np.eye(2), np.ones(2), 0.5)[0])


def test_rolling_betas_equal_a_regression_in_every_window(spark):
    rng = np.random.default_rng(4)
    rows = []
    for u, n, level in (("U", 140, 0.0), ("V", 95, 3.0), ("W", 20, 0.0)):
        f = level + 0.01 * rng.normal(size=(n, 3))
        y = 0.001 + f @ np.array([1.1, -0.4, 0.2]) + 0.002 * rng.normal(size=n)
        rows += [(u, datetime.date(2020, 1, 1) + datetime.timedelta(days=t), float(y[t]) + 1e-4, *map(float, f[t]), 1e-4) for t in range(n)]
    curves = table(spark.createDataFrame(rows, "universe string, dt date, p double, mkt_rf double, smb double, hml double, rf double"))
    frame = risk.ff3_rolling(curves, ["universe"], 60)
    plan = frame._jdf.queryExecution().toString()
    assert "specifiedwindowframe(RowFrame, -59" not in plan
    got = {(r["universe"], r["dt"]): r for r in frame.collect()}
    assert len(got) == len(rows)
    for u in "UVW":
        own = sorted(r for r in rows if r[0] == u)
        for t in range(len(own)):
            r = got[u, own[t][1]]
            if t < 59:
                assert r["beta_smb"] is None
                continue
            part = own[t - 59 : t + 1]
            x = np.column_stack([np.ones(60), [p[3:6] for p in part]])
            beta = np.linalg.lstsq(x, np.array([p[2] - p[6] for p in part]), rcond=None)[0]
            assert [r["beta_mkt_rf"], r["beta_smb"], r["beta_hml"]] == pytest.approx(beta[1:], rel=1e-6, abs=1e-6)


def test_quantiles_of_groups_of_any_kind(spark):
    rng = np.random.default_rng(5)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 400 + [8.0] * 30, "skew": np.exp(rng.normal(size=700) * 4).tolist(), "gap": [*([-1e12] * 5), *rng.normal(size=300).tolist(), 1e15], "some": [1.0, None, float("nan"), float("-inf"), 5.0], "far": [-1.7e308] * 30 + [1.7e308] * 30}
    rows = table(spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double"))
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["x"] for r in risk.quantile(rows, ["g"], "v", q, "x", bins=16, most=20).collect()}
        for g, vs in groups.items():
            if g == "far":
                assert got[g] in (-1.7e308, 1.7e308) or q == 0.5
                continue
            assert got[g] == pytest.approx(np.quantile([v for v in vs if v is not None and math.isfinite(v)], q), rel=1e-12)
    assert risk.quantile(rows.filter("false"), ["g"], "v", 0.5, "x").count() == 0


def test_quantile_of_ten_million_rows(spark):
    n = 10_000_000
    rows = spark.range(n, numPartitions=8).select(F.lit("g").alias("g"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    assert risk.quantile(rows, ["g"], "v", 0.95, "x").first()["x"] == pytest.approx(0.95 * (n - 1), rel=1e-12)
