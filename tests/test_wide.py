"""Fits on tables against the kernels on the whole problem."""

import numpy as np
import pytest

from basketry.functions import kernels
from basketry.operators import wide
from basketry.session import table


def problem(seed, n, p, useful=5, noise=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    useful = min(useful, p)
    return x, x[:, :useful] @ np.linspace(0.5, 0.1, useful) + noise * rng.normal(size=n)


def rows(spark, **problems):
    data = [(u, i, f"A{j:03d}", float(x[i, j]), float(y[i])) for u, (x, y) in problems.items() for i in range(x.shape[0]) for j in range(x.shape[1])]
    return table(spark.createDataFrame(data, "universe string, dt int, asset string, x double, y double"))


def weights(df, u, p):
    got = {r["asset"]: r["w"] for r in df.collect() if r["universe"] == u}
    return [got.get(f"A{j:03d}", 0.0) for j in range(p)]


@pytest.mark.parametrize("screen", [True, False])
def test_wide_fit_equals_the_kernel(spark, screen):
    """More assets than dates, two universes of different sizes; a working set of two new assets a round."""
    u, v = problem(1, 15, 60), problem(2, 20, 25)
    made = wide.wide_fit(rows(spark, u=u, v=v), 0.1, table, add=2, screen=screen)
    for r in made.report.collect():
        assert r["optimal"] and r["gap"] < 1e-6
    for name, (x, y) in (("u", u), ("v", v)):
        want = kernels.fit_l1(x.T @ x, x.T @ y, 0.1 * (x.T @ y).max())[0]
        assert weights(made.weights, name, x.shape[1]) == pytest.approx(want, abs=1e-7)
    assert screen or {(r["candidates"], r["rows"]) for r in made.log} == {(85, 15 * 60 + 20 * 25)}


def test_screening_reads_fewer_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 400))
    data = rows(spark, u=(x, x[:, :20] @ rng.uniform(0.1, 0.5, 20) + 0.05 * rng.normal(size=60)))
    full, less = (wide.wide_fit(data, 0.3, table, add=5, screen=s) for s in (False, True))
    assert weights(full.weights, "u", 400) == pytest.approx(weights(less.weights, "u", 400), abs=1e-9)
    assert len(less.log) == len(full.log) and less.log[-1]["candidates"] < 400 and full.log[-1]["candidates"] == 400
    # penalties of a second round of reweighting: all assets without weight are gone at once
    w = less.weights.select("universe", "asset", "w")
    each = data.select("universe", "asset").distinct().join(w, ["universe", "asset"], "left").selectExpr("universe", "asset", "0.01 / (coalesce(w, 0) + 0.001) as lam")
    again = wide.wide_fit(data, 0.3, table, each=table(each), start=w)
    assert again.report.first()["optimal"] and again.log[-1]["candidates"] < 100 and again.log[-1]["rows"] < 60 * 100


def test_nothing_to_fit_and_too_few_rounds(spark):
    x, y = problem(1, 15, 60)
    data = rows(spark, u=(x, y))
    none = wide.wide_fit(data, 1.5, table)
    assert none.weights.count() == 0 and none.report.first()["optimal"]
    with pytest.raises(RuntimeError, match="rounds"):
        wide.wide_fit(data, 0.01, table, add=1, rounds=2)
    assert wide.wide_fit(data.filter("false"), 0.1, table).report.count() == 0


def test_screening_never_drops_an_asset_of_the_optimum(spark):
    """At every penalty the screened and the unscreened fit are the kernel's; correlated assets are the hard case."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(24, 6))
    x = np.repeat(base, 8, axis=1) + 0.05 * rng.normal(size=(24, 48))
    y = base @ np.array([0.4, 0.3, 0.2, 0.1, 0.0, -0.2])
    data = rows(spark, u=(x, y))
    for frac in (0.5, 0.02):
        want = kernels.fit_l1(x.T @ x, x.T @ y, frac * (x.T @ y).max())[0]
        made = wide.wide_fit(data, frac, table, add=3)
        assert weights(made.weights, "u", 48) == pytest.approx(want, abs=1e-6)


def test_reweighted_equals_the_kernel(spark):
    u, v = problem(3, 30, 50), problem(4, 30, 20)
    got, supports = wide.wide_reweighted(rows(spark, u=u, v=v), 0.001, table)
    steps = {(r["universe"], r["round"]): r for r in supports.collect()}
    for name, (x, y) in (("u", u), ("v", v)):
        want = kernels.fit_reweighted(x.T @ x, x.T @ y, 0.001 * (x.T @ y).max())[0]
        assert weights(got, name, x.shape[1]) == pytest.approx(want, abs=1e-6)
        last = max(k for n, k in steps if n == name)
        assert steps[name, last]["changed"] == 0 or last == 4
        assert steps[name, last]["n_active"] == int((want > 1e-8).sum())


def test_greedy_equals_the_kernel(spark):
    """Two universes, one of which ends early; and a repeated asset, which depends on the one before."""
    u, w = problem(5, 40, 30), problem(6, 25, 10)
    x, y = problem(8, 12, 6, 2, 0.0)
    v = (np.hstack([x, x[:, :1]]), y)
    got, steps = wide.wide_greedy(rows(spark, u=u, v=v, w=w), 6, table)
    steps = {(r["universe"], r["iter"]): r for r in steps.collect()}
    for name, (a, b) in (("u", u), ("v", v), ("w", w)):
        g, c = a.T @ a, a.T @ b
        want, size, _, trace = kernels.fit_omp(g, c, float(b @ b), 6)
        mine = sorted(k for n, k in steps if n == name)
        if name != "v":
            assert weights(got, name, a.shape[1]) == pytest.approx(want, abs=1e-7) and len(mine) == size
        for k, rss, left, _ in trace:
            assert (steps[name, k]["rss"], steps[name, k]["left"]) == (pytest.approx(rss, abs=1e-8), pytest.approx(left, abs=1e-7))


def test_greedy_needs_a_size_and_may_find_nothing(spark):
    x, y = problem(5, 10, 3)
    with pytest.raises(ValueError):
        wide.wide_greedy(rows(spark, u=(x, y)), 0, table)
    got, steps = wide.wide_greedy(rows(spark, u=(np.abs(x), -np.abs(y) - 1)), 2, table)
    assert got.count() == 0 and steps.count() == 0


def test_the_factor_grows_like_a_new_one():
    x, y = problem(9, 30, 6)
    gram, factor, c, w = [], [], [], []
    for j in range(6):
        w, gram, factor, c = kernels.grown_fit(gram, factor, c, w, (x[:, :j].T @ x[:, j]).tolist(), float(x[:, j] @ x[:, j]), float(x[:, j] @ y))
        assert kernels._lower(factor) == pytest.approx(np.linalg.cholesky(x[:, : j + 1].T @ x[:, : j + 1]), abs=1e-9)
        assert w == pytest.approx(kernels.active_set(np.array(gram), np.array(c), np.zeros(j + 1), 1e-12), abs=1e-9)


def test_copies_take_no_rounds(spark):
    """Forty copies of every asset: as many rounds as without copies, the same fit, and all weight on the first copy by name."""
    x, y = problem(11, 15, 12)
    single = wide.wide_fit(rows(spark, u=(x, y)), 0.05, table, add=2)
    copied = wide.wide_fit(rows(spark, u=(np.repeat(x, 40, axis=1), y)), 0.05, table, add=2)
    want = weights(single.weights, "u", 12)
    got = np.reshape(weights(copied.weights, "u", 480), (12, 40))
    assert got[:, 0] == pytest.approx(want, abs=1e-9) and not got[:, 1:].any()
    assert len(copied.log) == len(single.log) and copied.report.first()["optimal"]


def test_few_steps_are_written_a_round(spark):
    """A round writes a fit and a judgement, and once in a while the rows that are left."""
    written = []

    def keep(df):
        written.append(df)
        return table(df)

    made = wide.wide_fit(rows(spark, u=problem(1, 15, 60)), 0.1, keep, add=2, screen=False)
    assert len(made.log) > 2 and len(written) <= 2 * len(made.log) + 5
