"""Queries of fits on tables, on a panel with an asset per supplier, and of whole penalty paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fit, moments, panel, wide
from ..session import table
from . import market
from .fitted import _scaled, descent, greedy, reweighting
from .queries import Tables, query, rounded

_WIDE = """, sup AS (
  SELECT r_name AS universe, 'S' || s_suppkey AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, sum(l_extendedprice) AS e, sum(l_quantity) AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
), sp AS (SELECT universe, asset, dt, sum(e) OVER w / sum(q) OVER w AS price FROM sup WINDOW w AS (PARTITION BY universe, asset ORDER BY dt ROWS UNBOUNDED PRECEDING)
), sgrid AS (SELECT d.universe, d.dt, a.asset, p.price FROM (SELECT DISTINCT universe, dt FROM sp) d JOIN (SELECT DISTINCT universe, asset FROM sp) a USING (universe) LEFT JOIN sp p USING (universe, dt, asset)
), sfill AS (SELECT universe, dt, asset, last_value(price IGNORE NULLS) OVER (PARTITION BY universe, asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS price FROM sgrid
), sret AS (SELECT universe, dt, asset, coalesce(price / lag(price) OVER (PARTITION BY universe, asset ORDER BY dt) - 1, 0) AS r FROM sfill
), slast AS (SELECT sret.*, ym.r AS y FROM sret JOIN ym USING (universe, dt) QUALIFY dense_rank() OVER (PARTITION BY sret.universe ORDER BY dt DESC) <= 24
), sx AS MATERIALIZED (SELECT universe, dt, asset, y, (r - avg(r) OVER v) / CASE WHEN stddev_pop(r) OVER v > 1e-12 THEN stddev_pop(r) OVER v ELSE 1 END AS x FROM slast WINDOW v AS (PARTITION BY universe, asset))"""


def supplier_panel(spark, sf_dir: str, months: int = 24) -> DataFrame:
    """universe, dt, asset, x, y over the last months: more assets than a panel of brands has."""
    t = Tables(spark, sf_dir)
    lines = t.read("lineitem").select("l_suppkey", F.col("l_shipdate").alias("d"), F.col("l_extendedprice").alias("e"), F.col("l_quantity").alias("q"))
    sums = lines.groupBy("l_suppkey", market.period("month").alias("dt")).agg(F.sum("e").alias("e"), F.sum("q").alias("q"))  # names join sums, not lines
    rows = sums.join(t.read("supplier"), F.expr("l_suppkey = s_suppkey")).join(t.read("nation"), F.expr("s_nationkey = n_nationkey")).join(t.read("region"), F.expr("n_regionkey = r_regionkey"))
    named = rows.select(F.col("r_name").alias("universe"), F.concat(F.lit("S"), "s_suppkey").alias("asset"), "dt", "e", "q").repartition("universe", "asset")
    prices = table(market.prices(named.groupBy("universe", "dt", "asset").agg(F.sum("e").alias("e"), F.sum("q").alias("q"))))
    r = table(panel.last_n(table(panel.align(panel.padded_returns(prices), t.bench("month"))), months))
    return table(panel.standardize(r, True).select("universe", "dt", "asset", "x", "y"))


@query(_WIDE + descent((0.1,), "sx", 4000) + "SELECT universe, true AS optimal, round(objective * 1e6, 3) AS objective FROM path")
def fit_wide(spark, sf_dir):
    """The table-based fit on the supplier panel: its objective, and whether it is optimal over all assets."""
    x = supplier_panel(spark, sf_dir)
    found = wide.wide_fit(x, 0.1, table)
    made = fit.objective(x, found.weights, ["universe"])
    return found.report.join(made, "universe").select("universe", "optimal", F.round(F.col("objective") * 1e6, 3).alias("objective"))


@query(_WIDE + descent((0.1,), "sx", 4000) + "SELECT universe, asset, round(w[i], 6) AS w FROM path JOIN pa USING (universe) WHERE w[i] > 1e-6")
def wide_weights(spark, sf_dir):
    """The weights of that fit, from working sets of five new assets a round, with safe screening."""
    found = wide.wide_fit(supplier_panel(spark, sf_dir), 0.1, table, add=5)
    return rounded(found.weights.drop("lam").filter("w > 1e-6"))


@query(_WIDE + greedy(8, "sx", 1500) + "SELECT picks.universe, CAST(iter AS INT) AS iter, asset, round(rss * 1e4, 5) AS rss, round(left_over * 1e4, 5) AS left_over FROM picks JOIN pa ON pa.universe = picks.universe AND pa.i = s[-1]")
def wide_greedy(spark, sf_dir):
    """The greedy fit on tables, eight assets of the supplier panel one after the other."""
    _, steps = wide.wide_greedy(supplier_panel(spark, sf_dir), 8, table)
    return steps.select("universe", "iter", "asset", *_scaled("rss"), F.round(F.col("left") * 1e4, 5).alias("left_over"))


@query(_WIDE + reweighting((0.0005,), "sx", 3000).replace("l.universe, l.lam_idx, asset", "l.universe, asset"))
def wide_reweighted(spark, sf_dir):
    """Reweighted fits on tables, over the supplier panel."""
    w, _ = wide.wide_reweighted(supplier_panel(spark, sf_dir), 0.0005, table)
    return rounded(w.filter("w > 1e-6"))


@query(descent(moments.FRACTIONS) + "SELECT universe, lam_idx, nnz, round(objective * 1e4, 5) AS objective, round(w_sum, 6) AS w_sum FROM path")
def exact_path(spark, sf_dir):
    """All penalties read off the breakpoints of one exact path per universe."""
    x = table(Tables(spark, sf_dir).train())
    paths = table(fit.l1_paths(x, ["universe"]))
    w = table(fit.at_penalties(paths, by=["universe"]))
    by = ["universe", "lam_idx"]
    flat = w.select(*by, "lam", F.inline_outer("weights")).select(*by, "lam", F.coalesce("asset", F.lit("")).alias("asset"), F.coalesce("w", F.lit(0.0)).alias("w"))
    size = F.size(F.filter("weights", lambda a: a["w"] > 1e-9)).cast("long")
    total = F.aggregate("weights", F.lit(0.0), lambda acc, a: acc + a["w"])
    made = fit.objective(x, flat, by).select(*by, *_scaled("objective"))
    return w.select(*by, size.alias("nnz"), F.round(total, 6).alias("w_sum")).join(made, by)


@query("SELECT universe, true AS optimal, n AS n_assets FROM (SELECT universe, count(DISTINCT asset) AS n FROM xm GROUP BY ALL)")
def path_breakpoints(spark, sf_dir):
    """Every breakpoint of every universe's path satisfies the optimality conditions, judged from the data."""
    x = table(Tables(spark, sf_dir).train())
    paths = table(fit.l1_paths(x, ["universe"]))
    judged = fit.kkt(x, paths, ["universe", "step"], ["universe"])
    return judged.groupBy("universe").agg(F.bool_and("optimal").alias("optimal"), F.max("n_assets").alias("n_assets"))
