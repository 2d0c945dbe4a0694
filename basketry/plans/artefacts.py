"""Queries that write a file of the library's formats to the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare, risk
from ..session import run_dir, table
from ..sources import files
from . import market
from .queries import YEAR, M, Tables, query, rounded


def _path(spark, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """, dates AS (SELECT universe, count(DISTINCT dt) AS n FROM pm GROUP BY universe), complete AS (SELECT universe, asset FROM pm JOIN dates USING (universe) GROUP BY universe, asset, n HAVING count(*) = n)
    SELECT pm.universe, 'prices' AS kind, dt, asset, round(price, 6) AS price FROM pm JOIN complete USING (universe, asset) UNION ALL SELECT universe, 'benchmark', dt, 'INDEX', round(price, 6) FROM bm"""
)
def price_panel_wide(spark, sf_dir):
    """A wide price table with a column per ticker for every universe, written, read and split into complete assets and the benchmark."""
    t = Tables(spark, sf_dir)
    prices = t.prices("month").select("universe", "dt", "asset", "price")
    index = market.benchmark(t.totals("month")).select("universe", "dt", F.lit("INDEX").alias("asset"), "price")
    long, out = table(prices.unionByName(index)), None
    for (universe,) in long.select("universe").distinct().orderBy("universe").collect():  # a file per universe, as its columns are its tickers
        own = long.filter(F.col("universe") == universe)
        names = [r[0] for r in own.select("asset").distinct().orderBy("asset").collect()]
        path = _path(spark, "prices")
        own.groupBy("dt").pivot("asset", names).agg(F.first("price")).write.option("header", True).csv(path)
        parts = files.price_panel(spark.read.option("header", True).csv(path), universe, "INDEX")
        both = parts["prices"].select("universe", F.lit("prices").alias("kind"), "dt", "asset", "price").unionByName(parts["benchmark"].select("universe", F.lit("benchmark").alias("kind"), "dt", F.lit("INDEX").alias("asset"), "price"))
        out = both if out is None else out.unionByName(both)
    return rounded(out)


@query("SELECT DISTINCT p_brand AS asset FROM part")
def universe_file(spark, sf_dir):
    path = _path(spark, "universe")
    files.write_universe(Tables(spark, sf_dir).read("part").select(F.col("p_brand").alias("asset")).distinct(), path)
    return files.read_universe(spark, path)


@query("SELECT asset, round(sum(e), 2) AS cap FROM ln GROUP BY asset")
def caps_file(spark, sf_dir):
    path = _path(spark, "caps")
    caps = Tables(spark, sf_dir).lines.groupBy("asset").agg(F.round(F.sum("e"), 2).alias("cap"))
    files.write_caps(caps, path, "lines", "2001-01-01T00:00:00Z")
    return files.read_caps(spark, path)


@query("SELECT dt, round(mkt_rf, 8) AS mkt_rf, round(smb, 8) AS smb, round(hml, 8) AS hml, round(rf, 8) AS rf FROM fac")
def factors_file(spark, sf_dir):
    path = _path(spark, "factors")
    files.write_factors(Tables(spark, sf_dir).factors(), path)
    return rounded(files.read_factors(spark, path), 8)


@query("SELECT universe, dt, asset, round(x, 6) AS x, round(y, 8) AS y FROM xm")
def train_arrays_file(spark, sf_dir):
    """Training arrays as a table partitioned by universe."""
    path = _path(spark, "train")
    files.write_table(Tables(spark, sf_dir).train().select("universe", "dt", "asset", "x", "y"), path, ("universe",))
    return spark.read.parquet(path).select("universe", "dt", "asset", F.round("x", 6).alias("x"), F.round("y", 8).alias("y"))


_RUN = "universe string, config map<string, string>, metadata struct<n_dates: bigint, n_methods: bigint, first_dt: date, last_dt: date, n_rebalances: int>, rebalance_dates array<string>, equity_curves map<string, map<string, double>>, turnover map<string, map<string, double>>, transaction_costs map<string, map<string, double>>, risk_metrics map<string, map<string, double>>, benchmark_curve map<string, double>, survivorship_bias_flag boolean"


@query(
    """, sz AS (SELECT universe, method, count(*) AS n_dates, round(arg_max(nav, dt), 4) AS last_nav FROM nav GROUP BY ALL), tz AS (SELECT universe, method, count(*) AS n_rebalances, round(sum(turnover), 6) AS turnover FROM turn GROUP BY ALL),
    cz AS (SELECT universe, method, round(sum(before * 5e-4 * traded), 3) AS cost FROM chain GROUP BY ALL), bz AS (SELECT universe, round(arg_max(nav, dt), 4) AS bench_last FROM bench GROUP BY ALL), rz AS (SELECT universe, method, round(avg(p) / stddev_samp(p) * sqrt(52), 6) AS sharpe FROM cur GROUP BY ALL)
    SELECT universe, method, n_dates, last_nav, n_rebalances, turnover, cost, bench_last, sharpe, '26' AS lookback, true AS biased FROM sz JOIN tz USING (universe, method) JOIN cz USING (universe, method) JOIN rz USING (universe, method) JOIN bz USING (universe)"""
)
def run_file(spark, sf_dir):
    """A run as one self-describing JSON record per universe: config, counts, curves, turnover, costs, benchmark and metrics."""
    t = Tables(spark, sf_dir)
    run = t.run()
    run = {k: table(v) if k not in ("survivorship_bias", "weights") else v for k, v in run.items()}
    metrics = risk.risk_core(risk.curve_returns(run["nav"], run["bench"], M), M, YEAR["week"])
    path = _path(spark, "run")
    files.write_records(files.run_artefact(run, {"lookback": 26, "frequency": "monthly"}, metrics), path)
    back = files.read_records(spark, path, _RUN)
    own = lambda name: F.element_at(F.col(name), F.col("method"))
    total = lambda name: F.aggregate(F.map_values(own(name)), F.lit(0.0), lambda acc, x: acc + x)
    last = lambda curve: F.element_at(curve, F.array_max(F.map_keys(curve)))
    rows = back.withColumn("method", F.explode(F.map_keys("equity_curves")))
    return rows.select(
        "universe", "method", F.size(own("equity_curves")).cast("long").alias("n_dates"), F.round(last(own("equity_curves")), 4).alias("last_nav"), F.size(own("turnover")).cast("long").alias("n_rebalances"), F.round(total("turnover"), 6).alias("turnover"),
        F.round(total("transaction_costs"), 3).alias("cost"), F.round(last(F.col("benchmark_curve")), 4).alias("bench_last"), F.round(F.element_at(own("risk_metrics"), "sharpe"), 6).alias("sharpe"), F.element_at("config", "lookback").alias("lookback"), F.col("survivorship_bias_flag").alias("biased"),
    )


@query("SELECT universe, asset, round(w, 8) AS w, CAST(row_number() OVER (PARTITION BY universe ORDER BY w DESC, asset) AS INT) AS pos FROM w10 QUALIFY row_number() OVER (PARTITION BY universe ORDER BY w DESC, asset) <= 3")
def results_file(spark, sf_dir):
    """Nested comparison results as JSON lines, read back and unnested."""
    path = _path(spark, "results")
    files.write_records(compare.top_holdings(Tables(spark, sf_dir).top10(), ["universe"], 3), path)
    back = files.read_records(spark, path, "universe string, top array<struct<asset: string, w: double>>")
    return back.select("universe", F.posexplode("top").alias("pos", "t")).select("universe", "t.asset", F.round("t.w", 8).alias("w"), (F.col("pos") + 1).alias("pos"))


@query("SELECT universe, asset, round(w, 8) AS w FROM w10 WHERE w > 0")
def active_file(spark, sf_dir):
    path = _path(spark, "active")
    files.write_active(Tables(spark, sf_dir).top10(), path)
    return rounded(spark.read.schema("universe string, asset string, w double").option("header", True).csv(path), 8)
