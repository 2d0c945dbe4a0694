"""Every query with a SQL twin gives the twin's rows on the small tables."""

import math
import os

import duckdb
import pytest

from basketry.plans import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["vwap_panel_week", "returns_padded", "complete_assets", "standardize_centered", "benchmark_fallback", "symbol_clean", "schedule_weekly", "train_windows", "factor_align_ffill3", "gram", "omp_first_step", "topn_cap", "random_n_ensemble", "nav_path", "turnover", "risk_core", "ff3", "pareto_rules", "regime_stress", "allocate_shares", "html_links", "fit_l1_weights", "reweighted", "omp_two", "fit_wide", "ebic_select", "lambda_path", "walkforward_fitted", "nav_membership", "ff3_tstats", "turnover_stats", "price_panel_wide", "caps_file", "factors_file", "train_arrays_file", "run_file", "results_file", "active_file", "universe_file"]


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, duck, name):
    got = core.queries()[name](spark, SF)
    want = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    found = rows_of(got.collect(), got.columns)
    assert found == rows_of(want.fetchall(), names)
    assert found or name == "complete_assets"


def test_every_twin_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())
