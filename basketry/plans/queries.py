"""All registered queries of the library, each with its DuckDB twin where SQL can express it.

A twin is a SELECT over the shared CTEs of :data:`PRELUDE`; unused ones cost nothing. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import accounting, allocate, compare, fit, moments, panel, risk, rules, schedule
from ..session import table
from ..sources import files
from . import market, walkforward

LOOKBACK = 26
YEAR = {"month": 12, "week": 52}

PRELUDE = """
WITH RECURSIVE ln AS (
  SELECT r_name AS universe, p_brand AS asset, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS e, l_quantity AS q, l_tax AS tax, p_size AS size, p_retailprice AS retail
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), em AS (
  SELECT universe, CAST(date_trunc('month', d) AS DATE) AS dt, asset, sum(e) AS e, sum(q) AS q FROM ln GROUP BY ALL
), pm AS (
  SELECT universe, dt, asset, sum(e) OVER w / sum(q) OVER w AS price, e AS cap FROM em WINDOW w AS (PARTITION BY universe, asset ORDER BY dt ROWS UNBOUNDED PRECEDING)
), ew AS (
  SELECT universe, CAST(date_trunc('week', d) AS DATE) AS dt, asset, sum(e) AS e, sum(q) AS q FROM ln GROUP BY ALL
), pw AS (
  SELECT universe, dt, asset, sum(e) OVER w / sum(q) OVER w AS price, e AS cap FROM ew WINDOW w AS (PARTITION BY universe, asset ORDER BY dt ROWS UNBOUNDED PRECEDING)
), bm0 AS (
  SELECT universe, dt, sum(e) AS e, sum(q) AS q FROM em GROUP BY ALL
), bm AS (
  SELECT universe, dt, sum(e) OVER w / sum(q) OVER w AS price FROM bm0 WINDOW w AS (PARTITION BY universe ORDER BY dt ROWS UNBOUNDED PRECEDING)
), ym AS (
  SELECT * FROM (SELECT universe, dt, price / lag(price) OVER (PARTITION BY universe ORDER BY dt) - 1 AS r FROM bm) WHERE r IS NOT NULL
), bw0 AS (
  SELECT universe, dt, sum(e) AS e, sum(q) AS q FROM ew GROUP BY ALL
), bw AS (
  SELECT universe, dt, sum(e) OVER w / sum(q) OVER w AS price FROM bw0 WINDOW w AS (PARTITION BY universe ORDER BY dt ROWS UNBOUNDED PRECEDING)
), yw AS (
  SELECT * FROM (SELECT universe, dt, price / lag(price) OVER (PARTITION BY universe ORDER BY dt) - 1 AS r FROM bw) WHERE r IS NOT NULL
), rm AS (
  SELECT universe, dt, asset, r FROM (SELECT *, price / lag(price) OVER (PARTITION BY universe, asset ORDER BY dt) - 1 AS r FROM pm) WHERE r IS NOT NULL
), grid AS (
  SELECT d.universe, d.dt, a.asset, p.price FROM (SELECT DISTINCT universe, dt FROM pw) d JOIN (SELECT DISTINCT universe, asset FROM pw) a USING (universe) LEFT JOIN pw p USING (universe, dt, asset)
), filled AS (
  SELECT universe, dt, asset, last_value(price IGNORE NULLS) OVER (PARTITION BY universe, asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS price FROM grid
), pad AS (
  SELECT universe, dt, asset, coalesce(price / lag(price) OVER (PARTITION BY universe, asset ORDER BY dt) - 1, 0) AS r FROM filled
), rw AS (
  SELECT pad.* FROM pad JOIN yw USING (universe, dt)
), cw AS (
  SELECT CAST(date_trunc('week', d) AS DATE) AS dt, avg(tax) / 252 AS r FROM ln GROUP BY ALL
), cal AS (
  SELECT universe, dt, CAST(row_number() OVER (PARTITION BY universe ORDER BY dt) - 1 AS INT) AS pos FROM (SELECT DISTINCT universe, dt FROM rw)
), sched AS (
  SELECT universe, max(dt) AS rebal_dt, max(pos) AS rpos FROM cal GROUP BY universe, date_trunc('month', dt)
), win AS (
  SELECT s.universe, s.rebal_dt, c.dt, r.asset, r.r FROM sched s JOIN cal c ON c.universe = s.universe AND c.pos BETWEEN s.rpos - 26 AND s.rpos - 1 JOIN rw r ON r.universe = c.universe AND r.dt = c.dt WHERE s.rpos >= 26
), capw AS (
  SELECT universe, rebal_dt, asset, sum(cap) AS cap FROM win JOIN pw USING (universe, dt, asset) GROUP BY ALL
), w_mean AS (
  SELECT universe, 'equal_mean' AS method, rebal_dt, asset, 1.0 / count(*) OVER (PARTITION BY universe, rebal_dt) AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY universe, rebal_dt ORDER BY m DESC, asset) AS rn FROM (SELECT universe, rebal_dt, asset, avg(r) AS m FROM win GROUP BY ALL)) WHERE rn <= 10
), capr AS (
  SELECT *, row_number() OVER (PARTITION BY universe, rebal_dt ORDER BY cap DESC, asset) AS rn FROM capw
), w_cap AS (
  SELECT universe, 'cap_weighted' AS method, rebal_dt, asset, cap / sum(cap) OVER (PARTITION BY universe, rebal_dt) AS w FROM capr WHERE rn <= 10
), w_eq AS (
  SELECT universe, 'equal_cap' AS method, rebal_dt, asset, 1.0 / count(*) OVER (PARTITION BY universe, rebal_dt) AS w FROM capr WHERE rn <= 10
), wts AS (
  SELECT * FROM w_cap UNION ALL SELECT * FROM w_eq
), reb AS (
  SELECT DISTINCT universe, method, rebal_dt, FROM wts
), nxt AS (
  SELECT *, lead(rebal_dt) OVER (PARTITION BY universe, method ORDER BY rebal_dt) AS next_dt FROM reb
), seg AS (
  SELECT c.universe, m.method, c.dt, (SELECT max(rebal_dt) FROM reb r WHERE r.universe = c.universe AND r.method = m.method AND r.rebal_dt <= c.dt) AS rebal_dt
  FROM cal c JOIN (SELECT DISTINCT universe, method FROM reb) m USING (universe)
), held AS (
  SELECT s.universe, s.method, s.rebal_dt, s.dt, w.asset, w.w * product(1 + r.r) OVER (PARTITION BY s.universe, s.method, s.rebal_dt, w.asset ORDER BY s.dt ROWS UNBOUNDED PRECEDING) AS d
  FROM seg s JOIN wts w USING (universe, method, rebal_dt) JOIN rw r ON r.universe = s.universe AND r.dt = s.dt AND r.asset = w.asset
), daily AS (
  SELECT universe, method, rebal_dt, dt, sum(d) AS g FROM held GROUP BY ALL
), whole AS (
  SELECT universe, method, rebal_dt, arg_max(g, dt) AS g_all, max(dt) AS dt FROM daily GROUP BY ALL
), closing AS (
  SELECT h.universe, h.method, n.next_dt AS rebal_dt, h.asset, h.d / o.g_all AS old
  FROM held h JOIN whole o USING (universe, method, rebal_dt, dt) JOIN nxt n USING (universe, method, rebal_dt) WHERE n.next_dt IS NOT NULL
), dw AS (
  SELECT universe, method, rebal_dt, asset, coalesce(w.w, 0) - coalesce(c.old, 0) AS dw FROM wts w FULL JOIN closing c USING (universe, method, rebal_dt, asset)
), traded AS (
  SELECT universe, method, rebal_dt, sum(abs(dw)) AS traded FROM dw GROUP BY ALL
), early AS (
  SELECT s.universe, s.method, s.dt, 1e6 * product(1 + coalesce(c.r, 0)) OVER (PARTITION BY s.universe, s.method ORDER BY s.dt ROWS UNBOUNDED PRECEDING) AS nav
  FROM seg s LEFT JOIN cw c USING (dt) WHERE s.rebal_dt IS NULL
), chain AS (
  SELECT o.universe, o.method, o.rebal_dt, t.traded, greatest(0, 1 - 5e-4 * t.traded) AS kept, e.opening
    * coalesce(product(o.g_all) OVER (PARTITION BY o.universe, o.method ORDER BY o.rebal_dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)
    * coalesce(product(greatest(0, 1 - 5e-4 * t.traded)) OVER (PARTITION BY o.universe, o.method ORDER BY o.rebal_dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before
  FROM whole o JOIN traded t USING (universe, method, rebal_dt) JOIN (SELECT universe, method, arg_max(nav, dt) AS opening FROM early GROUP BY ALL) e ON e.universe = o.universe AND e.method = o.method
), nav AS (
  SELECT universe, method, dt, nav FROM early UNION ALL SELECT universe, method, d.dt, c.before * c.kept * d.g FROM daily d JOIN chain c USING (universe, method, rebal_dt)
), turn AS (
  SELECT universe, method, rebal_dt, 0.5 * sum(abs(coalesce(n.w, 0) - coalesce(o.w, 0))) AS turnover
  FROM wts n FULL JOIN (SELECT w.universe, w.method, x.next_dt AS rebal_dt, w.asset, w.w FROM wts w JOIN nxt x USING (universe, method, rebal_dt) WHERE x.next_dt IS NOT NULL) o USING (universe, method, rebal_dt, asset) GROUP BY ALL
), bench AS (
  SELECT universe, dt, 1e6 * product(1 + r) OVER (PARTITION BY universe ORDER BY dt ROWS UNBOUNDED PRECEDING) AS nav FROM yw
), cur AS (
  SELECT universe, method, dt, p, b FROM (
    SELECT n.universe, n.method, n.dt, n.nav / lag(n.nav) OVER w - 1 AS p, b.nav / lag(b.nav) OVER w - 1 AS b FROM nav n JOIN bench b USING (universe, dt) WINDOW w AS (PARTITION BY n.universe, n.method ORDER BY n.dt)) WHERE p IS NOT NULL
), side AS (
  SELECT CAST(date_trunc('week', d) AS DATE) AS dt, sum(e) / sum(q) AS m, sum(e) FILTER (size <= 25) / sum(q) FILTER (size <= 25) AS s, sum(e) FILTER (size > 25) / sum(q) FILTER (size > 25) AS b,
    sum(e) FILTER (retail >= 950) / sum(q) FILTER (retail >= 950) AS h, sum(e) FILTER (retail < 950) / sum(q) FILTER (retail < 950) AS l, avg(tax) / 252 AS rf FROM ln GROUP BY ALL
), fac AS (
  SELECT * FROM (SELECT dt, m / lag(m) OVER (ORDER BY dt) - 1 - rf AS mkt_rf, (s / lag(s) OVER (ORDER BY dt)) - (b / lag(b) OVER (ORDER BY dt)) AS smb, (h / lag(h) OVER (ORDER BY dt)) - (l / lag(l) OVER (ORDER BY dt)) AS hml, rf FROM side)
  WHERE mkt_rf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL
), curf AS (
  SELECT c.*, f.mkt_rf, f.smb, f.hml, f.rf, c.p - f.rf AS y FROM cur c JOIN fac f USING (dt)
), full_m AS (
  SELECT universe, asset FROM (SELECT universe, asset, count(*) AS n FROM rm GROUP BY ALL) JOIN (SELECT universe, count(DISTINCT dt) AS n_dates FROM rm GROUP BY ALL) USING (universe) WHERE n = n_dates
), rmc AS (
  SELECT rm.*, y.r AS y FROM rm JOIN full_m USING (universe, asset) JOIN ym y USING (universe, dt)
), calm AS (
  SELECT universe, dt, row_number() OVER (PARTITION BY universe ORDER BY dt) - 1 AS pos FROM (SELECT DISTINCT universe, dt FROM rmc)
), tt AS (
  SELECT rmc.*, CASE WHEN pos < 48 THEN 'train' ELSE 'test' END AS split FROM rmc JOIN calm USING (universe, dt) WHERE pos < 72
), st AS (
  SELECT universe, asset, avg(r) AS mu, stddev_pop(r) AS sigma FROM tt WHERE split = 'train' GROUP BY ALL
), xm AS (
  SELECT tt.*, (tt.r - mu) / CASE WHEN sigma > 1e-12 THEN sigma ELSE 1 END AS x, tt.r / CASE WHEN sigma > 1e-12 THEN sigma ELSE 1 END AS xs FROM tt JOIN st USING (universe, asset) WHERE split = 'train'
), wm AS (
  SELECT universe, asset, cap, row_number() OVER (PARTITION BY universe ORDER BY cap DESC, asset) AS rn FROM (SELECT universe, asset, sum(e) AS cap FROM ln GROUP BY ALL)
), w10 AS (
  SELECT universe, asset, cap / sum(cap) OVER (PARTITION BY universe) AS w FROM wm WHERE rn <= 10
), lastp AS (
  SELECT universe, asset, arg_max(price, dt) AS price FROM pw GROUP BY ALL
)
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: str = PRELUDE):
    """Registers a query under its function's name, with its twin over PRELUDE, or over another one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = prelude + sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


class Tables:
    """The tables of one run, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.lines = market.lines(spark, sf_dir)
        self._totals: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return market.read(self.spark, self.sf_dir, name)

    def totals(self, freq: str) -> DataFrame:
        """The lines' sums by period, written once for all tables that are made from them."""
        if freq not in self._totals:
            self._totals[freq] = table(market.totals(self.lines, freq))
        return self._totals[freq]

    def prices(self, freq: str = "month") -> DataFrame:
        return market.prices(self.totals(freq))

    def bench(self, freq: str = "month") -> DataFrame:
        return market.benchmark_returns(self.totals(freq))

    def factors(self) -> DataFrame:
        return market.factors(self.totals("week"))

    def monthly(self) -> DataFrame:
        return panel.simple_returns(self.prices("month"))

    def weekly(self) -> DataFrame:
        return panel.align(panel.padded_returns(self.prices("week")), self.bench("week")).drop("y")

    def cash(self, r: DataFrame) -> DataFrame:
        return panel.with_cash(panel.calendar(r), market.cash(self.totals("week")))

    def aligned(self) -> DataFrame:
        return panel.align(panel.complete_assets(self.monthly()), self.bench("month"))

    def train_test(self) -> DataFrame:
        return panel.split(self.aligned(), 48, 24)

    def train(self, centred: bool = True) -> DataFrame:
        return panel.standardize(self.train_test(), centred, where=F.col("split") == "train").filter("split = 'train'")

    def windows(self, r: DataFrame | None = None) -> DataFrame:
        r = self.weekly() if r is None else r
        return schedule.train_windows(r, schedule.monthly(r), LOOKBACK)

    def caps(self) -> DataFrame:
        """From the lines, or from sums that are written already."""
        rows = next(iter(self._totals.values()), self.lines)
        return rows.groupBy("universe", "asset").agg(F.sum("e").alias("cap"))

    def top10(self) -> DataFrame:
        return rules.top_n_cap(self.caps(), 10, ["universe"])

    def run(self, methods=("cap_weighted", "equal_cap"), settings: dict | None = None, **how) -> dict[str, DataFrame]:
        r = table(self.weekly())
        return walkforward.run(r, self.bench("week"), self.cash(r), walkforward.Config(methods=methods, lookback=LOOKBACK, **(settings or {})), caps=self.prices("week"), **how)

    def curves(self, methods=("cap_weighted", "equal_cap")) -> DataFrame:
        out = self.run(methods)
        return risk.curve_returns(out["nav"], out["bench"], ["universe", "method"])

    def with_factors(self) -> DataFrame:
        return table(self.curves()).join(self.factors(), "dt")


M = ["universe", "method"]

# ---- panels ----------------------------------------------------------------------------------------


@query("SELECT universe, dt, asset, round(price, 6) AS price, round(cap, 2) AS cap FROM pw")
def vwap_panel_week(spark, sf_dir):
    return rounded(Tables(spark, sf_dir).prices("week").withColumn("cap", F.round("cap", 2)))


@query("SELECT universe, dt, asset, round(r, 8) AS r FROM rm")
def returns_simple(spark, sf_dir):
    return rounded(Tables(spark, sf_dir).monthly(), 8)


@query("SELECT universe, dt, asset, round(r, 8) AS r FROM (SELECT *, ln(price / lag(price) OVER (PARTITION BY universe, asset ORDER BY dt)) AS r FROM pm) WHERE r IS NOT NULL")
def returns_log(spark, sf_dir):
    return rounded(panel.log_returns(Tables(spark, sf_dir).prices("month")), 8)


@query("SELECT universe, dt, asset, round(r, 8) AS r FROM pad")
def returns_padded(spark, sf_dir):
    return rounded(panel.padded_returns(Tables(spark, sf_dir).prices("week")), 8)


@query("SELECT universe, dt, asset, round(r, 8) AS r, round(y.r, 8) AS y FROM rm JOIN (SELECT universe, dt, r FROM ym) y USING (universe, dt)".replace("round(r, 8)", "round(rm.r, 8)"))
def align_benchmark(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(panel.align(t.monthly(), t.bench()), 8)


@query("SELECT universe, asset, count(*) AS n FROM rm JOIN full_m USING (universe, asset) GROUP BY ALL")
def complete_assets(spark, sf_dir):
    return panel.complete_assets(Tables(spark, sf_dir).monthly()).groupBy("universe", "asset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT universe, dt, count(price) AS n FROM grid GROUP BY ALL HAVING count(price) > 0")
def drop_empty_dates(spark, sf_dir):
    dense = panel.densify(Tables(spark, sf_dir).prices("week"))
    return panel.drop_empty_dates(dense, "price").groupBy("universe", "dt").agg(F.count("price").alias("n"))


@query("SELECT universe, dt, asset, round(r, 8) AS r FROM (SELECT *, dense_rank() OVER (PARTITION BY universe ORDER BY dt DESC) AS k FROM rm) WHERE k <= 24")
def last_n_slice(spark, sf_dir):
    return rounded(panel.last_n(Tables(spark, sf_dir).monthly(), 24), 8)


@query("SELECT universe, split, count(*) AS n, count(DISTINCT dt) AS dates, round(sum(r), 8) AS total FROM tt GROUP BY ALL")
def train_test_split(spark, sf_dir):
    rows = Tables(spark, sf_dir).train_test()
    return rounded(rows.groupBy("universe", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dt").alias("dates"), F.sum("r").alias("total")), 8)


@query("SELECT universe, asset, count(*) AS n FROM tt JOIN (SELECT universe, asset FROM tt WHERE split = 'train' GROUP BY ALL HAVING var_pop(r) > 1e-4) USING (universe, asset) GROUP BY ALL")
def variance_filter(spark, sf_dir):
    rows = panel.varying_assets(Tables(spark, sf_dir).train_test(), 1e-4, F.col("split") == "train")
    return rows.groupBy("universe", "asset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT universe, dt, asset, round(x, 6) AS x FROM xm")
def standardize_centered(spark, sf_dir):
    return rounded(Tables(spark, sf_dir).train().select("universe", "dt", "asset", "x"))


@query("SELECT universe, dt, asset, round(xs, 6) AS x FROM xm")
def standardize_scaled(spark, sf_dir):
    return rounded(Tables(spark, sf_dir).train(centred=False).select("universe", "dt", "asset", "x"))


@query("SELECT universe, asset FROM (SELECT DISTINCT universe, asset FROM ln) WHERE (universe, asset) NOT IN (SELECT (universe, min(asset)) FROM ln GROUP BY universe)")
def exclude_benchmark(spark, sf_dir):
    assets = Tables(spark, sf_dir).lines.select("universe", "asset").distinct()
    return panel.without_benchmark(assets, assets.groupBy("universe").agg(F.min("asset").alias("benchmark")))


@query("SELECT universe, dt, pos, round(coalesce(cw.r, 0), 10) AS cash FROM cal LEFT JOIN cw USING (dt)")
def cash_alignment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(t.cash(t.weekly()), 10)


@query("SELECT universe, min(dt) AS first_dt, max(dt) AS last_dt, min(dt) > DATE '1996-01-01' AS starts_late, max(dt) < DATE '1999-12-31' AS ends_early FROM rm WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY universe")
def clip_coverage(spark, sf_dir):
    rows = panel.clip_dates(Tables(spark, sf_dir).monthly(), "1996-01-01", "1999-12-31")
    return panel.coverage(rows, "1996-01-01", "1999-12-31")


@query("SELECT p_brand AS universe, p_partkey AS asset, p_partkey AS ord FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE n <= 80 OR rn <= 20")
def universe_cap(spark, sf_dir):
    parts = Tables(spark, sf_dir).read("part").select(F.col("p_brand").alias("universe"), F.col("p_partkey").alias("asset"), F.col("p_partkey").alias("ord"))
    return panel.cap_universe(parts, 80, 20)


_CANDIDATES = "c AS (SELECT universe, asset AS candidate, row_number() OVER (PARTITION BY universe ORDER BY asset) AS rank FROM (SELECT DISTINCT universe, asset FROM ln)), s AS (SELECT c.universe, c.rank, c.candidate, p.dt, CASE WHEN c.rank >= 3 OR p.dt IS NULL THEN p.price END AS price FROM c JOIN pm p ON p.universe = c.universe AND p.asset = c.candidate)"


@query(f", {_CANDIDATES} SELECT universe, CAST(rank AS INT) AS rank, candidate, dt, round(price, 6) AS price FROM s WHERE price IS NOT NULL AND rank = (SELECT min(rank) FROM s s2 WHERE s2.universe = s.universe AND s2.price IS NOT NULL)")
def benchmark_fallback(spark, sf_dir):
    p = Tables(spark, sf_dir).prices("month")
    ranks = p.select("universe", "asset").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("universe").orderBy("asset")))
    rows = p.join(ranks, ["universe", "asset"]).select("universe", "rank", F.col("asset").alias("candidate"), "dt", F.when(F.col("rank") >= 3, F.col("price")).alias("price"))
    return rounded(panel.benchmark_fallback(rows))


@query("SELECT p_partkey, replace(nullif(nullif(nullif(upper(trim(regexp_replace(p_brand || CASE WHEN p_partkey % 3 = 0 THEN '.b[1]' WHEN p_partkey % 3 = 1 THEN ' ' ELSE '' END, '\\[[^\\]]*\\]', '', 'g'))), ''), '-'), 'NAN'), '.', '-') AS symbol, CASE WHEN upper(trim(p_type)) LIKE '%.NS' THEN upper(trim(p_type)) ELSE upper(trim(p_type)) || '.NS' END AS listed FROM part")
def symbol_clean(spark, sf_dir):
    raw = F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, ".b[1]").when(F.col("p_partkey") % 3 == 1, " ").otherwise(""))
    return Tables(spark, sf_dir).read("part").select("p_partkey", panel.clean_symbol(raw).alias("symbol"), panel.clean_symbol(F.col("p_type"), ".NS").alias("listed"))


@query("SELECT p_name AS sym, min(p_partkey) AS pos FROM part GROUP BY p_name")
def dedupe_first(spark, sf_dir):
    return panel.first_distinct(Tables(spark, sf_dir).read("part").select(F.col("p_name").alias("sym"), F.col("p_partkey").alias("pos")), "sym", "pos")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(coalesce(p_type, '')), 'economy')")
def equity_filter(spark, sf_dir):
    return panel.of_class(Tables(spark, sf_dir).read("part").select("p_partkey", "p_type"), "p_type", "economy")


@query("SELECT n AS name, r_name AS universe FROM (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE ' ' || lower(r_name) || '-' END AS n, CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE lower(replace(r_name, ' ', '')) END AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) LEFT JOIN region ON lower(replace(r_name, ' ', '')) = k")
def index_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.read("customer").join(t.read("nation"), F.expr("c_nationkey = n_nationkey")).join(t.read("region"), F.expr("n_regionkey = r_regionkey"))
    name = F.when(F.col("c_custkey") % 7 == 0, "nowhere").otherwise(F.concat(F.lit(" "), F.lower("r_name"), F.lit("-")))
    return panel.lookup_index(rows.select(name.alias("name")).distinct(), t.read("region").select(F.col("r_name").alias("universe")))


@query("SELECT p_partkey, round(coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice * 1000 END, p_size * coalesce(CASE WHEN p_size % 3 <> 0 THEN p_retailprice END, p_retailprice / 2)), 4) AS cap FROM part")
def cap_resolve(spark, sf_dir):
    price = F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(F.col("p_retailprice"))
    cap = panel.resolved_cap(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") * 1000), F.col("p_size"), price, F.col("p_retailprice") / 2)
    return rounded(Tables(spark, sf_dir).read("part").select("p_partkey", cap.alias("cap")), 4)


def _cache(t: Tables) -> DataFrame:
    part = t.read("part").filter("p_partkey % 3 <> 0")
    return part.select(F.col("p_partkey").alias("asset"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("cap"))


@query("SELECT p_partkey AS asset FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def cap_refresh_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return panel.keys_to_refresh(t.read("part").select(F.col("p_partkey").alias("asset")), _cache(t), refetch_missing=True)


@query("SELECT p_partkey AS asset, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1.0 WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN p_retailprice END AS cap FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def cap_upsert(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fresh = t.read("part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("asset"), F.col("p_size").cast("double").alias("cap"))
    return panel.upsert_caps(_cache(t), fresh)


@query("SELECT p_partkey AS asset, coalesce(CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN p_retailprice END, 1.0) AS cap FROM part")
def cap_align(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return panel.caps_for(t.read("part").select(F.col("p_partkey").alias("asset")), _cache(t), 1.0)


@query("SELECT universe, dt, asset, round(price * CASE WHEN asset < 'Brand#2' THEN 3.0 ELSE 1.0 END, 4) AS cap FROM pm")
def cap_proxy(spark, sf_dir):
    p = Tables(spark, sf_dir).prices("month").drop("cap")
    shares = p.select("asset").distinct().filter("asset < 'Brand#2'").withColumn("shares", F.lit(3.0))
    return rounded(panel.proxy_caps(p, shares).select("universe", "dt", "asset", "cap"), 4)


@query("SELECT universe, asset, max(dt) AS dt, round(arg_max(price, dt), 6) AS price FROM pw GROUP BY ALL")
def latest_price(spark, sf_dir):
    return rounded(panel.latest_prices(Tables(spark, sf_dir).prices("week")))


@query("SELECT user_id, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) = 1")
def latest_event_value(spark, sf_dir):
    """Every user's last value; of several at one time, the largest."""
    e = Tables(spark, sf_dir).read("events").filter("value is not null")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "value"))["value"].alias("value"))


@query("SELECT universe, dt, round(sum(w * r), 8) AS r FROM rm JOIN w10 USING (universe, asset) GROUP BY ALL")
def portfolio_projection(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(panel.portfolio_returns(t.monthly(), t.top10(), []), 8)


@query("SELECT universe, dt, round(max(nav) FILTER (method = 'cap_weighted'), 4) AS cap_weighted, round(max(nav) FILTER (method = 'equal_cap'), 4) AS equal_cap FROM nav GROUP BY ALL")
def pivot_series(spark, sf_dir):
    return rounded(panel.pivoted(Tables(spark, sf_dir).run()["nav"], ["cap_weighted", "equal_cap"]), 4)


# ---- calendars -------------------------------------------------------------------------------------

_DAYS = "dd AS (SELECT DISTINCT universe, d AS dt FROM ln), dc AS (SELECT universe, dt, CAST(row_number() OVER (PARTITION BY universe ORDER BY dt) - 1 AS INT) AS pos FROM dd)"


@query(f", {_DAYS} SELECT universe, max(dt) AS rebal_dt, max(pos) AS rpos FROM dc GROUP BY universe, isoyear(dt), weekofyear(dt)")
def schedule_weekly(spark, sf_dir):
    return schedule.weekly(Tables(spark, sf_dir).lines.select("universe", F.col("d").alias("dt")))


@query(f", {_DAYS} SELECT universe, max(dt) AS rebal_dt, max(pos) AS rpos FROM dc GROUP BY universe, date_trunc('month', dt)")
def schedule_monthly(spark, sf_dir):
    return schedule.monthly(Tables(spark, sf_dir).lines.select("universe", F.col("d").alias("dt")))


@query("SELECT universe, rebal_dt, min(dt) AS first_dt, max(dt) AS last_dt, count(DISTINCT dt) AS dates, count(*) AS n, round(sum(r), 8) AS total FROM win GROUP BY ALL")
def train_windows(spark, sf_dir):
    w = Tables(spark, sf_dir).windows().groupBy("universe", "rebal_dt")
    return rounded(w.agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.countDistinct("dt").alias("dates"), F.count(F.lit(1)).alias("n"), F.sum("r").alias("total")), 8)


@query(
    """, mem AS (SELECT universe, CAST(date_trunc('week', d) AS DATE) AS dt, asset FROM ln GROUP BY ALL HAVING count(*) >= 2)
    SELECT w.universe, w.rebal_dt, w.asset, l.dt IS NULL OR m.asset IS NOT NULL AS active, round(sum(CASE WHEN l.dt IS NULL OR m.asset IS NOT NULL THEN w.r ELSE 0 END), 8) AS total
    FROM win w LEFT JOIN (SELECT DISTINCT universe, dt FROM mem) l ON l.universe = w.universe AND l.dt = w.rebal_dt LEFT JOIN mem m ON m.universe = w.universe AND m.dt = w.rebal_dt AND m.asset = w.asset GROUP BY ALL"""
)
def membership_mask(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = schedule.masked(t.windows(), market.membership(t.totals("week"), 2))
    return rounded(rows.groupBy("universe", "rebal_dt", "asset", "active").agg(F.sum("r").alias("total")), 8)


@query(
    """, f AS (SELECT c.universe, c.dt, last_value(f.mkt_rf IGNORE NULLS) OVER w AS mkt_rf, last_value(f.smb IGNORE NULLS) OVER w AS smb, last_value(f.hml IGNORE NULLS) OVER w AS hml
      FROM cal c LEFT JOIN (SELECT * FROM fac WHERE day(dt) <= 12) f USING (dt) WINDOW w AS (PARTITION BY c.universe ORDER BY c.dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT universe, dt, round(mkt_rf, 8) AS mkt_rf, round(smb, 8) AS smb, round(hml, 8) AS hml FROM f WHERE mkt_rf IS NOT NULL"""
)
def factor_align_ffill3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    some = t.factors().filter("day(dt) <= 12")
    return rounded(schedule.align_factors(panel.calendar(t.weekly()), some, ["mkt_rf", "smb", "hml"]), 8)


_REGIMES = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}', DATE '{e}')" for a, b, c, d, e in market.REGIMES) + ") v(regime, short, type, start_dt, end_dt))"


@query(f", {_REGIMES} SELECT universe, regime, type, count(*) AS n, round(sum(r), 8) AS total FROM rw JOIN reg ON dt >= start_dt AND dt < end_dt GROUP BY ALL")
def regime_assign(spark, sf_dir):
    rows = schedule.assign_regimes(Tables(spark, sf_dir).weekly(), market.regimes(spark))
    return rounded(rows.groupBy("universe", "regime", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total")), 8)


@query("SELECT universe, dt, round(r, 8) AS r FROM yw WHERE dt >= DATE '1997-01-01'")
def window_filter(spark, sf_dir):
    return rounded(schedule.window_filter(Tables(spark, sf_dir).bench("week"), "1997-01-01", "no date"), 8)


@query("SELECT universe, dt, round(r, 8) AS r FROM (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY dt) AS rn, count(*) OVER (PARTITION BY universe) AS n FROM yw) WHERE (rn - 1) % CAST(ceil(n / 50.0) AS BIGINT) = 0 OR rn = n")
def downsample(spark, sf_dir):
    return rounded(schedule.downsample(Tables(spark, sf_dir).bench("week"), ["universe"], 50), 8)


@query("SELECT universe, round(datediff('day', min(dt), max(dt)) / 365.25, 6) AS years FROM yw GROUP BY universe")
def span_years(spark, sf_dir):
    return rounded(schedule.span_years(Tables(spark, sf_dir).bench("week"), ["universe"]))


# ---- moments and fits ------------------------------------------------------------------------------


@query("SELECT a.universe, a.asset AS i, b.asset AS j, round(sum(a.x * b.x), 5) AS g FROM xm a JOIN xm b ON a.universe = b.universe AND a.dt = b.dt AND a.asset <= b.asset GROUP BY ALL")
def gram(spark, sf_dir):
    return rounded(moments.gram(Tables(spark, sf_dir).train(), ["universe"]), 5)


@query("SELECT universe, asset, round(sum(x * y), 6) AS c FROM xm GROUP BY ALL")
def xty(spark, sf_dir):
    return rounded(moments.xty(Tables(spark, sf_dir).train(), ["universe"]))


_LAM = "lm AS (SELECT universe, greatest(max(c), 1e-10) AS lam_max FROM (SELECT universe, asset, sum(x * y) AS c FROM xm GROUP BY ALL) GROUP BY universe)"


@query(f", {_LAM} SELECT universe, round(lam_max, 8) AS lam_max FROM lm")
def lambda_max(spark, sf_dir):
    return rounded(moments.lambda_max(Tables(spark, sf_dir).train(), ["universe"]), 8)


@query(f", {_LAM} SELECT universe, CAST(k AS INT) AS lam_idx, round(lam_max, 8) AS lam_max, round(lam_max * pow(0.001, 1 - k / 19.0), 8) AS lam FROM lm, range(20) t(k)")
def lambda_grid(spark, sf_dir):
    return rounded(moments.lambda_grid(moments.lambda_max(Tables(spark, sf_dir).train(), ["universe"]), 20), 8)


@query(f", {_LAM} SELECT universe, CAST(k - 1 AS INT) AS lam_idx, CAST(f AS DOUBLE) AS lam_frac, round(lam_max, 8) AS lam_max, round(f * lam_max, 8) AS lam FROM lm, (SELECT unnest({[*moments.FRACTIONS]}) AS f, generate_subscripts({[*moments.FRACTIONS]}, 1) AS k)")
def lambda_fractions(spark, sf_dir):
    return rounded(moments.fraction_grid(moments.lambda_max(Tables(spark, sf_dir).train(), ["universe"])), 8)


def _fits(t: Tables, methods=("fista",), **how) -> tuple[DataFrame, DataFrame]:
    x = table(t.train())
    return x, table(fit.fit_windows(x, methods, by=["universe"], **how))


_FITTED = "SELECT DISTINCT universe FROM xm"


@query(f"SELECT universe, m AS method, CAST(k AS INT) AS lam_idx, true AS optimal, n AS n_assets FROM ({_FITTED}) u JOIN (SELECT universe, count(DISTINCT asset) AS n FROM xm GROUP BY ALL) USING (universe), (SELECT unnest(['fista', 'cd', 'admm']) AS m), range(12) t(k)")
def fit_l1_kkt(spark, sf_dir):
    """All fits of three algorithms satisfy the optimality conditions, judged from the data."""
    x, fits = _fits(Tables(spark, sf_dir), ("fista", "cd", "admm"))
    return fit.kkt(x, fits, ["universe", "method", "lam_idx"], ["universe"])


@query(
    """, c AS (SELECT universe, asset, sum(x * y) AS c, sum(x * x) AS g FROM xm GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY c DESC, asset) AS rn FROM c WHERE c > 0)
    SELECT universe, asset, round(c / g, 8) AS w FROM r WHERE rn = 1"""
)
def omp_first_step(spark, sf_dir):
    _, fits = _fits(Tables(spark, sf_dir), ("omp",), cardinality=1)
    return rounded(fit.fit_weights(fits, ["universe"]), 8)


#: Penalties that fall by a tenth from step to step.
_STEPS = tuple(round(0.9**k, 9) for k in range(60))


@query(f"SELECT universe, CAST(min(i) AS INT) AS lam_idx FROM (SELECT universe, max(c) AS top FROM (SELECT universe, asset, sum(x * y) AS c FROM xm GROUP BY ALL) GROUP BY universe), (SELECT unnest({[*_STEPS]}) AS lam, unnest(range({len(_STEPS)})) AS i) WHERE lam < top GROUP BY universe")
def lambda_fallback(spark, sf_dir):
    """A ladder of penalties that are the same for all universes: each ends at the first step with weights, which is the first below its own largest useful penalty."""
    _, fits = _fits(Tables(spark, sf_dir), fractions=(), lams=_STEPS)
    return fit.first_nonempty(fits, ["universe"], _STEPS).select("universe", "lam_idx")


@query("SELECT universe, asset, round(w / sum(w) OVER (PARTITION BY universe), 8) AS w FROM (SELECT universe, asset, cap / sum(cap) OVER (PARTITION BY universe) AS w FROM wm) WHERE w >= 0.04")
def simplex_weights(spark, sf_dir):
    caps = Tables(spark, sf_dir).caps()
    raw = caps.withColumn("w", F.col("cap") / F.sum("cap").over(Window.partitionBy("universe"))).drop("cap")
    return rounded(rules.to_simplex(raw, ["universe"], 0.04), 8)


@query("SELECT universe, asset, round(v / sum(v) OVER (PARTITION BY universe), 8) AS w FROM (SELECT w10.universe, w10.asset, w / sigma AS v FROM w10 JOIN st USING (universe, asset))")
def destandardize(spark, sf_dir):
    t = Tables(spark, sf_dir)
    stats = panel.asset_stats(t.train_test(), where=F.col("split") == "train")
    return rounded(rules.destandardize(t.top10(), stats, ["universe"], 0.0), 8)


# ---- rule portfolios -------------------------------------------------------------------------------


@query("SELECT universe, rebal_dt, asset, round(w, 8) AS w FROM w_cap")
def topn_cap(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cap = t.windows().select("universe", "rebal_dt", "dt", "asset").join(t.prices("week"), ["universe", "dt", "asset"]).groupBy("universe", "rebal_dt", "asset").agg(F.sum("cap").alias("cap"))
    return rounded(rules.top_n_cap(cap, 10, ["universe", "rebal_dt"]), 8)


@query("SELECT universe, asset, CAST(0.2 AS DOUBLE) AS w FROM wm WHERE rn <= 5")
def equal_topn_cap(spark, sf_dir):
    return rounded(rules.equal_top_n_cap(Tables(spark, sf_dir).caps(), 5, ["universe"]), 8)


@query("SELECT universe, rebal_dt, asset, round(w, 8) AS w FROM w_mean")
def equal_topn_mean(spark, sf_dir):
    return rounded(rules.equal_top_n_mean(Tables(spark, sf_dir).windows(), 10, ["universe", "rebal_dt"]), 8)


@query(
    """, e AS (SELECT universe, asset, k, row_number() OVER (PARTITION BY universe, k ORDER BY md5(k || ':' || asset), asset) AS rn FROM (SELECT DISTINCT universe, asset FROM ln), range(10) t(k))
    SELECT universe, asset, round(CAST(count(*) * 0.01 AS DOUBLE), 8) AS w FROM e WHERE rn <= 10 GROUP BY ALL"""
)
def random_n_ensemble(spark, sf_dir):
    return rounded(rules.random_ensemble(Tables(spark, sf_dir).lines.select("universe", "asset").distinct(), 10, ["universe"]), 8)


@query("SELECT universe, count(*) AS n_active, round(sum(w * w), 8) AS hhi, round(1 / sum(w * w), 6) AS effective_n, round(sum(w), 8) AS w_sum, round(max(w), 8) AS w_max, round(min(w), 8) AS w_min_active FROM w10 GROUP BY universe")
def vector_stats(spark, sf_dir):
    out = rules.vector_stats(Tables(spark, sf_dir).top10(), ["universe"])
    return rounded(out.withColumn("effective_n", F.round("effective_n", 6)), 8)


# ---- accounting ------------------------------------------------------------------------------------


@query("SELECT universe, method, rebal_dt, dt, asset, round(d / g, 8) AS w FROM held JOIN daily USING (universe, method, rebal_dt, dt)")
def drift_weights(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = table(t.weekly())
    w = table(walkforward.target_weights(r, t.bench("week"), walkforward.Config(methods=("cap_weighted", "equal_cap"), lookback=LOOKBACK), t.prices("week")))
    held = table(accounting.growth(w, r, accounting.segments(w, r)))
    return rounded(accounting.drifted(held).select(*M, "rebal_dt", "dt", "asset", "w"), 8)


@query("SELECT universe, method, rebal_dt, round(traded, 8) AS traded, round(before * 5e-4 * traded, 4) AS cost FROM chain")
def trades_cost_linear(spark, sf_dir):
    out = Tables(spark, sf_dir).run()["rebalances"].drop("turnover")
    return rounded(out.withColumn("cost", F.round("cost", 4)), 8)


@query("SELECT universe, method, rebal_dt, round(traded, 8) AS traded, round(0.1 * 0.02 * sqrt(0.01) * traded, 10) AS share FROM chain")
def trades_cost_sqrt(spark, sf_dir):
    traded = Tables(spark, sf_dir).run()["rebalances"].select(*M, "rebal_dt", "traded")
    return rounded(traded.withColumn("share", F.round(accounting.sqrt_impact_cost(0.1, 0.02, 0.01) * F.col("traded"), 10)).withColumn("traded", F.round("traded", 8)), 10)


@query("SELECT universe, method, rebal_dt, round(turnover, 8) AS turnover FROM turn")
def turnover(spark, sf_dir):
    return rounded(Tables(spark, sf_dir).run()["rebalances"].select(*M, "rebal_dt", "turnover"), 8)


@query("SELECT universe, method, dt, round(nav, 4) AS nav FROM nav")
def nav_path(spark, sf_dir):
    return rounded(Tables(spark, sf_dir).run()["nav"], 4)


@query("SELECT universe, dt, round(nav, 4) AS nav FROM bench")
def benchmark_curve(spark, sf_dir):
    return rounded(accounting.compounded(Tables(spark, sf_dir).bench("week"), ["universe"], 1e6), 4)


@query("SELECT universe, asset, dt, round(100 * product(1 + r) OVER (PARTITION BY universe, asset ORDER BY dt ROWS UNBOUNDED PRECEDING), 6) AS nav FROM rm")
def rebased_curve(spark, sf_dir):
    return rounded(accounting.compounded(Tables(spark, sf_dir).monthly(), ["universe", "asset"]))


# ---- risk ------------------------------------------------------------------------------------------

_CORE = """SELECT universe, method, count(*) AS n, round(pow(product(1 + p), 52.0 / count(*)) - 1, 6) AS ann_return, round(stddev_samp(p) * sqrt(52), 6) AS ann_vol, round(avg(p) / stddev_samp(p) * sqrt(52), 6) AS sharpe,
  round(avg(p) / sqrt(avg(pow(least(p, 0), 2))) * sqrt(52), 6) AS sortino, round(stddev_samp(p - b) * sqrt(52), 6) AS tracking_error, round(avg(p - b) / stddev_samp(p - b) * sqrt(52), 6) AS information_ratio,
  round(pow(product(1 + b), 52.0 / count(*)) - 1, 6) AS bench_return, round(stddev_samp(b) * sqrt(52), 6) AS bench_vol FROM cur GROUP BY ALL"""


@query(_CORE)
def risk_core(spark, sf_dir):
    return rounded(risk.risk_core(Tables(spark, sf_dir).curves(), M, YEAR["week"]))


@query("SELECT universe, method, dt, round(nav / max(nav) OVER (PARTITION BY universe, method ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1, 8) AS dd FROM nav")
def drawdown_series(spark, sf_dir):
    return rounded(risk.drawdowns(Tables(spark, sf_dir).run()["nav"], M), 8)


@query("SELECT universe, method, round(min(dd), 8) AS max_drawdown, round(sqrt(avg(dd * dd)), 8) AS ulcer FROM (SELECT universe, method, nav / max(nav) OVER (PARTITION BY universe, method ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nav) GROUP BY ALL")
def drawdown_stats(spark, sf_dir):
    return rounded(risk.drawdown_stats(Tables(spark, sf_dir).run()["nav"], M), 8)


@query(
    """, d AS (SELECT universe, method, min(dd) AS m FROM (SELECT universe, method, nav / max(nav) OVER (PARTITION BY universe, method ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nav) GROUP BY ALL)
    SELECT universe, method, round((pow(product(1 + p), 52.0 / count(*)) - 1) / abs(any_value(m)), 6) AS calmar FROM cur JOIN d USING (universe, method) GROUP BY ALL"""
)
def calmar(spark, sf_dir):
    out = Tables(spark, sf_dir).run()
    core = risk.risk_core(risk.curve_returns(out["nav"], out["bench"], M), M, YEAR["week"])
    return rounded(risk.calmar(core, risk.drawdown_stats(out["nav"], M), M))


@query("SELECT universe, method, round(regr_intercept(p - 1e-5, b - 1e-5), 8) AS alpha_daily, round(pow(1 + regr_intercept(p - 1e-5, b - 1e-5), 52) - 1, 6) AS alpha, round(regr_slope(p, b), 6) AS beta, round(regr_r2(p, b), 6) AS r2, count(*) AS n FROM cur GROUP BY ALL")
def capm(spark, sf_dir):
    out = risk.capm(Tables(spark, sf_dir).curves(), M, YEAR["week"], rf=1e-5).withColumn("alpha_daily", F.round("alpha_daily", 8))
    return out.withColumns({c: F.round(c, 6) for c in ("alpha", "beta", "r2")})


_FF3 = """, mo AS (SELECT universe, method{dt}, {agg}covar_pop(mkt_rf, mkt_rf){w} AS a, {agg}covar_pop(mkt_rf, smb){w} AS b, {agg}covar_pop(mkt_rf, hml){w} AS c, {agg}covar_pop(smb, smb){w} AS d, {agg}covar_pop(smb, hml){w} AS e, {agg}covar_pop(hml, hml){w} AS f,
  covar_pop(mkt_rf, y){w} AS u, covar_pop(smb, y){w} AS v, covar_pop(hml, y){w} AS x, avg(y){w} AS my, avg(mkt_rf){w} AS m1, avg(smb){w} AS m2, avg(hml){w} AS m3, var_pop(y){w} AS vy, count(y){w} AS n FROM curf {tail}),
be AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det, u * (d * f - e * e) - b * (v * f - e * x) + c * (v * e - d * x) AS t1, a * (v * f - e * x) - u * (b * f - e * c) + c * (b * x - v * c) AS t2,
  a * (d * x - v * e) - b * (b * x - v * c) + u * (b * e - d * c) AS t3 FROM mo) """


@query(
    _FF3.format(dt="", agg="", w="", tail="GROUP BY ALL")
    + "SELECT universe, method, round(pow(1 + my - t1 / det * m1 - t2 / det * m2 - t3 / det * m3, 52) - 1, 5) AS alpha, round(t1 / det, 5) AS beta_mkt_rf, round(t2 / det, 5) AS beta_smb, round(t3 / det, 5) AS beta_hml, round((t1 * u + t2 * v + t3 * x) / det / vy, 5) AS r2, n FROM be"
)
def ff3(spark, sf_dir):
    return rounded(risk.ff3(Tables(spark, sf_dir).with_factors(), M, YEAR["week"]), 5)


@query(
    _FF3.format(dt=", dt", agg="", w=" OVER w", tail="WINDOW w AS (PARTITION BY universe, method ORDER BY dt ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)")
    + "SELECT universe, method, dt, CASE WHEN n >= 90 THEN round(t1 / det, 4) + 0.0::DOUBLE END AS beta_mkt_rf, CASE WHEN n >= 90 THEN round(t2 / det, 4) + 0.0::DOUBLE END AS beta_smb, CASE WHEN n >= 90 THEN round(t3 / det, 4) + 0.0::DOUBLE END AS beta_hml FROM be"
)
def ff3_rolling(spark, sf_dir):
    return rounded(risk.ff3_rolling(Tables(spark, sf_dir).with_factors(), M), 4)


@query("SELECT universe, method, round(avg(h), 8) AS hhi_avg, round(quantile_cont(h, 0.95), 8) AS hhi_p95, round(avg(t), 8) AS max_weight_avg, round(max(t), 8) AS max_weight, round(1 / avg(h), 6) AS effective_n_avg FROM (SELECT universe, method, rebal_dt, sum(w * w) AS h, max(w) AS t FROM wts GROUP BY ALL) GROUP BY ALL")
def concentration(spark, sf_dir):
    out = risk.concentration(Tables(spark, sf_dir).run()["weights"], M)
    return rounded(out.withColumn("effective_n_avg", F.round("effective_n_avg", 6)), 8)


@query(
    """SELECT universe, method, round(stddev_pop(p - b) * sqrt(52) * 100, 5) AS te_pct, round(corr(p, b), 6) AS correlation, round(max(abs(p - b)) * 100, 6) AS max_daily_gap_pct, round((product(1 + p) - 1) * 100, 5) AS total_pct,
    round((product(1 + b) - 1) * 100, 5) AS bench_total_pct, round(1 - sum((b - p) * (b - p)) / (var_pop(b) * count(*)), 5) AS r2 FROM cur GROUP BY ALL"""
)
def tracking(spark, sf_dir):
    out = risk.tracking_percent(Tables(spark, sf_dir).curves(), M, YEAR["week"])
    return rounded(out.withColumns({c: F.round(c, 5) for c in ("te_pct", "total_pct", "bench_total_pct", "r2")}))


@query("SELECT universe, method, round(max(g), 8) AS max_cumulative_gap FROM (SELECT universe, method, abs(product(1 + p) OVER w - product(1 + b) OVER w) AS g FROM cur WINDOW w AS (PARTITION BY universe, method ORDER BY dt ROWS UNBOUNDED PRECEDING)) GROUP BY ALL")
def cumulative_gap(spark, sf_dir):
    return rounded(risk.max_cumulative_gap(Tables(spark, sf_dir).curves(), M), 8)


# ---- comparisons -----------------------------------------------------------------------------------

#: Caps over the training dates, and the rules that rank by them.
_RANKED = """, tcap AS (SELECT universe, asset, sum(cap) AS cap FROM tt JOIN pm USING (universe, dt, asset) WHERE split = 'train' GROUP BY ALL), trank AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY cap DESC, asset) AS rn FROM tcap)"""
_HOLD = (
    _RANKED
    + """, allw AS (SELECT universe, 'cap' AS method, asset, cap / sum(cap) OVER (PARTITION BY universe) AS w FROM trank WHERE rn <= 10 UNION ALL SELECT universe, 'equal', asset, 1.0 / count(*) OVER (PARTITION BY universe) FROM trank WHERE rn <= 10),
pr AS (SELECT universe, method, dt, sum(w * r) AS p, any_value(y) AS b FROM tt JOIN allw USING (universe, asset) WHERE split = 'test' GROUP BY ALL), hn AS (SELECT universe, method, count(*) AS n_active FROM allw WHERE w > 1e-6 GROUP BY ALL),
hold AS (SELECT universe, method, any_value(n_active) AS n_active, 1 - sum((b - p) * (b - p)) / (var_pop(b) * count(*)) AS r2, stddev_samp(p - b) * sqrt(12) AS te, avg(p - b) / stddev_samp(p - b) * sqrt(12) AS ir, avg(p) / stddev_samp(p) * sqrt(12) AS sharpe, sum((b - p) * (b - p)) AS rss
  FROM pr JOIN hn USING (universe, method) GROUP BY ALL) """
)


def _ranked_caps(t: Tables) -> DataFrame:
    return table(_train_caps(t.train_test(), t.prices("month").drop("price")))


def _methods(t: Tables) -> DataFrame:
    caps = _ranked_caps(t)
    return compare.compare({"cap": rules.top_n_cap(caps, 10, ["universe"]), "equal": rules.equal_top_n_cap(caps, 10, ["universe"])})


def _holdout(t: Tables, weights: DataFrame, by: list[str]) -> DataFrame:
    test = table(t.train_test().filter("split = 'test'"))
    return compare.holdout_metrics(weights, test, test.select("universe", "dt", F.col("y").alias("r")).distinct(), by, YEAR["month"])


@query(_HOLD + "SELECT universe, method, round(r2, 5) AS r2, round(te, 6) AS te, round(ir, 6) AS ir, round(sharpe, 6) AS sharpe, round(rss, 8) AS rss, n_active FROM hold")
def method_comparison(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = _holdout(t, _methods(t), ["method"])
    return out.withColumns({"r2": F.round("r2", 5), "te": F.round("te", 6), "ir": F.round("ir", 6), "sharpe": F.round("sharpe", 6), "rss": F.round("rss", 8)})


@query(_HOLD + "SELECT universe, round(r2, 5) AS r2, round(te, 6) AS te FROM hold WHERE method = 'cap'")
def headline(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = compare.headline(_holdout(t, _methods(t), ["method"]), "cap", ["r2", "te"])
    return out.withColumns({"r2": F.round("r2", 5), "te": F.round("te", 6)})


@query(
    _RANKED
    + """, sw AS (SELECT universe, k AS n, asset, cap / sum(cap) OVER (PARTITION BY universe, k) AS w FROM trank, (SELECT unnest([3, 5, 8, 12]) AS k) WHERE rn <= k),
    pr AS (SELECT universe, n, dt, sum(w * r) AS p, any_value(y) AS b FROM tt JOIN sw USING (universe, asset) WHERE split = 'test' GROUP BY ALL),
    h AS (SELECT universe, n, round(stddev_samp(p - b) * sqrt(12), 9) AS te FROM pr GROUP BY ALL), z AS (SELECT universe, n, count(*) AS n_active FROM sw GROUP BY ALL)
    SELECT universe, n, n_active, round(te, 6) AS te, coalesce(te < min(te) OVER (PARTITION BY universe ORDER BY n_active, te, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS efficient FROM h JOIN z USING (universe, n)"""
)
def pareto_rules(spark, sf_dir):
    t = Tables(spark, sf_dir)
    caps, sweep = _ranked_caps(t), None
    for n in (3, 5, 8, 12):
        one = rules.top_n_cap(caps, n, ["universe"]).withColumn("n", F.lit(n))
        sweep = one if sweep is None else sweep.unionByName(one)
    return rounded(compare.pareto(_holdout(t, sweep, ["n"]).select("universe", "n", "n_active", F.round("te", 9).alias("te")), "n"))


@query(_HOLD + "SELECT r_name AS universe, n_active, round(r2, 5) AS r2, CASE WHEN n_active IS NULL THEN 'no weights' END AS error FROM (SELECT r_name FROM region UNION ALL SELECT 'nowhere') LEFT JOIN (SELECT universe, r2, n_active FROM hold WHERE method = 'cap') ON universe = r_name")
def multi_universe(spark, sf_dir):
    t = Tables(spark, sf_dir)
    universes = t.read("region").select(F.col("r_name").alias("universe")).unionByName(spark.range(1).select(F.lit("nowhere").alias("universe")))
    found = compare.headline(_holdout(t, _methods(t), ["method"]), "cap", ["n_active", "r2"])
    return compare.with_failures(universes, found, F.lit("no weights")).withColumn("r2", F.round("r2", 5))


_STRESS = f""", {_REGIMES}, rr AS (SELECT rw.*, regime, type, yw.r AS b FROM rw JOIN reg ON rw.dt >= start_dt AND rw.dt < end_dt JOIN yw USING (universe, dt)),
pr AS (SELECT universe, regime, type, dt, sum(w * r) AS p, any_value(b) AS b FROM rr JOIN w10 USING (universe, asset) GROUP BY ALL),
sm AS (SELECT universe, regime, type, count(*) AS n, stddev_pop(p - b) * sqrt(52) * 100 AS te_pct, corr(p, b) AS correlation, 1 - sum((b - p) * (b - p)) / (var_pop(b) * count(*)) AS r2 FROM pr GROUP BY ALL HAVING count(*) >= 20) """


def _stress(t: Tables) -> DataFrame:
    by = ["universe", "regime", "type"]
    rows = schedule.assign_regimes(panel.align(t.weekly(), t.bench("week")), market.regimes(t.spark))
    p = rows.join(t.top10(), ["universe", "asset"]).groupBy(*by, "dt").agg(F.sum(F.col("w") * F.col("r")).alias("p"), F.first("y").alias("b"))
    size = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")
    return risk.tracking_percent(p, by, YEAR["week"]).join(size, by).select(*by, "n", "te_pct", "correlation", "r2")


@query(_STRESS + "SELECT universe, regime, type, n, round(te_pct, 5) AS te_pct, round(correlation, 5) AS correlation, round(r2, 5) AS r2 FROM sm")
def regime_stress(spark, sf_dir):
    return rounded(_stress(Tables(spark, sf_dir)), 5)


@query(_STRESS + "SELECT universe, regime, r2 > 0.5 AND te_pct < 15 AS passed FROM sm")
def regime_pass(spark, sf_dir):
    return compare.regime_verdict(_stress(Tables(spark, sf_dir))).select("universe", "regime", "passed")


@query(_STRESS + "SELECT type, count(*) AS n, round(avg(r2), 4) AS r2_avg, round(avg(te_pct), 4) AS te_avg, bool_and(r2 > 0.5 AND te_pct < 15) AS all_passed FROM sm GROUP BY type")
def regime_type_avg(spark, sf_dir):
    return rounded(compare.type_averages(compare.regime_verdict(_stress(Tables(spark, sf_dir)))), 4)


@query("SELECT universe, array_to_string(list(asset ORDER BY w DESC, asset)[1:3], ',') AS assets FROM w10 GROUP BY universe")
def top_holdings(spark, sf_dir):
    top = compare.top_holdings(Tables(spark, sf_dir).top10(), ["universe"], 3)
    return top.select("universe", F.array_join(F.transform("top", lambda x: x["asset"]), ",").alias("assets"))


@query("SELECT event_type AS method, user_id % 4 AS p, round(avg(value), 6) AS mean_s, round(stddev_pop(value), 6) AS std_s, count(*) AS n FROM events GROUP BY ALL")
def timing_rollup(spark, sf_dir):
    e = Tables(spark, sf_dir).read("events")
    return rounded(compare.timing_rollup(e.select(F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("p"), F.col("value").alias("seconds"))))


@query("SELECT user_id % 4 AS p, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'error'), 6) AS error, round(avg(value) FILTER (event_type = 'click') / avg(value) FILTER (event_type = 'error'), 6) AS error_speedup FROM events GROUP BY ALL")
def speedup_pivot(spark, sf_dir):
    e = Tables(spark, sf_dir).read("events")
    runs = compare.timing_rollup(e.select(F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("p"), F.col("value").alias("seconds")))
    return rounded(compare.speedups(runs, "click", ["error"]))


@query(
    """, pr AS (SELECT universe, split, dt, sum(w * r) AS p, any_value(y) AS b FROM tt JOIN w10 USING (universe, asset) GROUP BY ALL)
    SELECT universe, round(1 - sum((b - p) * (b - p)) FILTER (split = 'train') / (var_pop(b) FILTER (split = 'train') * count(*) FILTER (split = 'train')), 5) AS r2_train, round(stddev_pop(p - b) FILTER (split = 'train') * sqrt(12) * 100, 5) AS te_train,
    round(corr(p, b) FILTER (split = 'train'), 5) AS corr_train, count(*) FILTER (split = 'train') AS n_train, round(1 - sum((b - p) * (b - p)) FILTER (split = 'test') / (var_pop(b) FILTER (split = 'test') * count(*) FILTER (split = 'test')), 5) AS r2_test,
    round(stddev_pop(p - b) FILTER (split = 'test') * sqrt(12) * 100, 5) AS te_test, round(corr(p, b) FILTER (split = 'test'), 5) AS corr_test, count(*) FILTER (split = 'test') AS n_test FROM pr GROUP BY universe"""
)
def in_vs_out(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t.train_test().join(t.top10(), ["universe", "asset"]).groupBy("universe", "split", "dt").agg(F.sum(F.col("w") * F.col("r")).alias("p"), F.first("y").alias("b"))
    return rounded(compare.in_vs_out(p, ["universe"], YEAR["month"]), 5)


# Fits beside rules. Everything is fitted or ranked on training dates only. The queries and their twins are in ``compared``.

_FIT_METHODS = ("fista", "cd", "admm", "reweighted", "reweighted_relative", "omp")


def _train_caps(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """(universe, asset, cap) over the training dates of ``rows``; ``caps``: universe, dt, asset, cap."""
    return rows.filter("split = 'train'").join(caps, ["universe", "dt", "asset"]).groupBy("universe", "asset").agg(F.sum("cap").alias("cap"))


def _all_methods(rows: DataFrame, caps: DataFrame, methods: tuple[str, ...] = _FIT_METHODS) -> DataFrame:
    """(universe, method, asset, w) of three rules and the fits on one split: the largest caps, equal weights on them, the mean of a hundred random portfolios."""
    _, fitted = compare.ladder_fit(rows, methods)
    caps = table(_train_caps(rows, caps))
    both = compare.compare({"cap": rules.top_n_cap(caps, 10, ["universe"]), "equal": rules.equal_top_n_cap(caps, 10, ["universe"]), "random": rules.random_ensemble(caps.select("universe", "asset"), 10, ["universe"], 100)})
    return table(fitted.unionByName(both))


def _on_test(rows: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    test = rows.filter("split = 'test'")
    return compare.holdout_metrics(weights, test, test.select("universe", "dt", F.col("y").alias("r")).distinct(), by, YEAR["month"])


def _all_holdout(t: Tables, methods: tuple[str, ...] = _FIT_METHODS) -> DataFrame:
    rows = table(t.train_test())
    return _on_test(rows, _all_methods(rows, t.prices("month").drop("price"), methods), ["method"])


def _regime_split(t: Tables, n_train: int = 20, n_test: int = 10) -> DataFrame:
    """Every (universe, regime) as a universe of its own, split by its own dates; those with fewer dates are left out."""
    rows = schedule.assign_regimes(panel.align(t.weekly(), t.bench("week")), market.regimes(t.spark))
    own = rows.withColumn("universe", F.concat_ws("|", "universe", "regime")).select("universe", "type", "dt", "asset", "r", "y")
    short = panel.too_short(own, n_train + n_test).select("universe")
    return table(panel.split(own.join(short, "universe", "left_anti"), n_train, n_test))


# ---- allocation and reports ------------------------------------------------------------------------

_ACC = """, acc AS (SELECT c_custkey AS account, r_name AS universe, c_acctbal * 100 AS capital FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0),
bought AS (SELECT account, universe, asset, w, price, CAST(floor(capital * w / price) AS BIGINT) AS shares FROM acc JOIN w10 USING (universe) JOIN lastp USING (universe, asset) WHERE price > 0) """


def _accounts(t: Tables) -> DataFrame:
    rows = t.read("customer").join(t.read("nation"), F.expr("c_nationkey = n_nationkey")).join(t.read("region"), F.expr("n_regionkey = r_regionkey"))
    return rows.filter("c_acctbal > 0").select(F.col("c_custkey").alias("account"), F.col("r_name").alias("universe"), (F.col("c_acctbal") * 100).alias("capital"))


@query(_ACC + "SELECT account, universe, asset, shares FROM bought WHERE shares > 0")
def allocate_shares(spark, sf_dir):
    t = Tables(spark, sf_dir)
    latest = panel.latest_prices(t.prices("week"))
    return allocate.allocate(_accounts(t), t.top10(), latest).select("account", "universe", "asset", "shares")


@query(_ACC + "SELECT account, a.universe, round(capital, 2) AS capital, coalesce(n, 0) AS n_bought, CAST(0 AS BIGINT) AS n_warnings, coalesce(invested, 0) <= capital AS within FROM acc a LEFT JOIN (SELECT account, count(*) AS n, sum(round(shares * price, 2)) AS invested FROM bought WHERE shares > 0 GROUP BY account) b USING (account)")
def allocation_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    latest = panel.latest_prices(t.prices("week"))
    out = allocate.allocation_summary(_accounts(t), t.top10(), latest)
    return out.select("account", "universe", F.round("capital", 2).alias("capital"), "n_bought", F.size("warnings").cast("long").alias("n_warnings"), (F.col("invested") <= F.col("capital")).alias("within"))


@query("SELECT w10.universe, CAST(row_number() OVER (PARTITION BY w10.universe ORDER BY w DESC, asset) AS INT) AS rank, asset, round(w, 8) AS w, round((1 - 10.0 / n) * 100, 1) AS reduction_pct FROM w10 JOIN (SELECT universe, count(DISTINCT asset) AS n FROM ln GROUP BY universe) USING (universe)")
def ranked_holdings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(allocate.holdings_report(t.top10(), t.lines.groupBy("universe").agg(F.countDistinct("asset").alias("n"))), 8)


@query("SELECT universe, round(sum(w), 8) AS w_sum, count(*) AS n_active, array_to_string(list_sort(list(asset ORDER BY w DESC, asset)[1:5]), ',') AS top FROM w10 GROUP BY universe")
def health_top5(spark, sf_dir):
    out = allocate.health(Tables(spark, sf_dir).top10(), 5)
    return rounded(out.withColumn("top", F.array_join(F.sort_array(F.map_keys("top")), ",")), 8)


@query("SELECT universe, method, dt, round(nav, 4) AS nav FROM (SELECT *, row_number() OVER (PARTITION BY universe, method ORDER BY dt) AS rn, count(*) OVER (PARTITION BY universe, method) AS n FROM nav WHERE dt BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') WHERE (rn - 1) % CAST(ceil(n / 60.0) AS BIGINT) = 0 OR rn = n")
def series_report(spark, sf_dir):
    return rounded(allocate.series_report(Tables(spark, sf_dir).run()["nav"], M, "1996-01-01", "2000-12-31", 60), 4)


# ---- sources ---------------------------------------------------------------------------------------


@query("SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>')) AS a FROM pages) GROUP BY page_id")
def html_links(spark, sf_dir):
    return files.html_links(Tables(spark, sf_dir).read("pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query("SELECT universe, asset, round(w, 8) AS w FROM w10 WHERE w > 0")
def active_holdings(spark, sf_dir):
    return rounded(files.active_holdings(Tables(spark, sf_dir).top10()), 8)


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS v FROM part")
def sanitize(spark, sf_dir):
    v = F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).when(F.col("p_size") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return files.sanitized(Tables(spark, sf_dir).read("part").select("p_partkey", v.alias("v")))


@query("SELECT universe, method, count(*) AS n FROM nav GROUP BY ALL")
def run_maps(spark, sf_dir):
    return files.run_maps(Tables(spark, sf_dir).run()["nav"]).select("universe", "method", F.size("curve").cast("long").alias("n"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d') || ' - ' || strftime(max(ts), '%Y-%m-%d') AS span, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def compact_export(spark, sf_dir):
    e = Tables(spark, sf_dir).read("events").withColumn("p", F.from_json("props", "k bigint"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    nested = e.groupBy("user_id").agg(F.struct(F.concat_ws(" - ", day(F.min("ts")), day(F.max("ts"))).alias("span"), F.sum("p.k").alias("k")).alias("r"))
    return files.compact(nested, {"user_id": "user_id", "r.span": "span", "r.k": "k"})


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice * 0.9 END, p_retailprice) AS price FROM part")
def price_fallback(spark, sf_dir):
    part = Tables(spark, sf_dir).read("part")
    both = part.select("p_partkey", F.col("p_retailprice").alias("close"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") * 0.9).alias("adj_close"))
    return both.select("p_partkey", files.price_field().alias("price"))


@query("SELECT p_brand AS file, p_partkey AS line, 'P' || p_partkey AS asset, p_name || ', x' AS name, p_type AS class FROM part WHERE p_type IS NOT NULL")
def holdings_parse(spark, sf_dir):
    """Parts as one holdings file per brand: a preamble, a header, quoted names."""
    part = Tables(spark, sf_dir).read("part")
    row = F.concat(F.lit("P"), "p_partkey", F.lit(',"'), "p_name", F.lit(', x",'), "p_type")
    body = part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), row.alias("value"))
    top = body.select("file").distinct()
    head = [top.select("file", F.lit(-k).cast("long").alias("line"), F.lit(v).alias("value")) for k, v in ((4, "Fund,All"), (3, ""), (2, "As of,P1,x"), (1, "Ticker,Name,Asset Class"))]
    for h in head:
        body = body.unionByName(h)
    return files.holdings(body)


@query("SELECT CAST(s_nationkey AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS pos, 'S' || s_suppkey AS symbol FROM supplier")
def html_constituents(spark, sf_dir):
    """Suppliers as one page per nation; the second table has the symbols."""
    rows = Tables(spark, sf_dir).read("supplier").select(F.col("s_nationkey").cast("long").alias("page_id"), F.struct("s_suppkey", F.concat(F.lit("<tr><td>"), "s_name", F.lit("</td><td><b>S"), "s_suppkey", F.lit("</b></td></tr>")).alias("row")).alias("r"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), "")
    start = "<p>x</p><table><tr><th>Year</th></tr><tr><td>1</td></tr></table><table class='w'><tr><th>Name</th><th>Symbol</th></tr>"
    return files.html_constituents(rows.groupBy("page_id").agg(F.concat(F.lit(start), body, F.lit("</table>")).alias("html")))


@query("SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS dt, round(max(o_totalprice) / 100, 6) AS mkt_rf, 0.01::DOUBLE AS smb, (-0.02)::DOUBLE AS hml, round(count(*) / 100, 6) AS rf FROM orders GROUP BY ALL")
def factor_parse(spark, sf_dir):
    """Orders by day as the daily section of a factor file, with a header before and an annual section behind it."""
    days = Tables(spark, sf_dir).read("orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.max("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.date_format("dt", "yyyyMMdd"), F.lit(", "), F.col("m").cast("decimal(20,2)"), F.lit(", 1.00, -2.00, "), "n")
    day = F.datediff("dt", F.lit("1970-01-01"))
    lines = days.select(F.year("dt").cast("string").alias("file"), day.cast("long").alias("line"), text.alias("value"))
    top = lines.select("file").distinct()
    for k, v in ((-1, ",Mkt-RF,SMB,HML,RF"), (10**6, " Annual Factors"), (10**6 + 1, "20001231, 1, 1, 1, 1")):
        lines = lines.unionByName(top.select("file", F.lit(k).cast("long").alias("line"), F.lit(v).alias("value")))
    return rounded(files.parse_factors(lines))


@query("SELECT r_name AS asset FROM region WHERE (SELECT count(DISTINCT p_type) FROM part) < 45 UNION ALL SELECT DISTINCT p_type FROM part WHERE (SELECT count(DISTINCT p_type) FROM part) >= 45")
def static_fallback(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return files.or_static(t.read("part").select(F.col("p_type").alias("asset")).distinct(), t.read("region").select(F.col("r_name").alias("asset")))


@query("SELECT DISTINCT p_brand AS asset FROM part WHERE (SELECT count(DISTINCT p_brand) FROM part) >= 20 UNION ALL SELECT r_name FROM region WHERE (SELECT count(DISTINCT p_brand) FROM part) < 20")
def static_not_needed(spark, sf_dir):
    """The other branch of the fallback: the parsed list is long enough."""
    t = Tables(spark, sf_dir)
    return files.or_static(t.read("part").select(F.col("p_brand").alias("asset")).distinct(), t.read("region").select(F.col("r_name").alias("asset")), 20)


@query("SELECT universe, count(DISTINCT dt) AS n_dates FROM (SELECT p_brand AS universe, CAST(l_shipdate AS DATE) AS dt FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY universe HAVING count(DISTINCT dt) < 1500")
def short_universes(spark, sf_dir):
    """Brands as universes: those with too few dates."""
    days = Tables(spark, sf_dir).lines.select(F.col("asset").alias("universe"), F.col("d").alias("dt"))
    return panel.too_short(days, 1500)


@query(
    _ACC.replace("JOIN lastp USING (universe, asset) WHERE price > 0", "JOIN (SELECT * FROM lastp WHERE asset < 'Brand#2') USING (universe, asset) WHERE price > 0")
    + """, gone AS (SELECT account, count(*) AS n_warnings, min(asset) AS first_missing FROM acc JOIN w10 USING (universe) ANTI JOIN (SELECT * FROM lastp WHERE asset < 'Brand#2') z ON z.universe = acc.universe AND z.asset = w10.asset GROUP BY account)
    SELECT a.account, coalesce(n, 0) AS n_bought, coalesce(n_warnings, 0) AS n_warnings, 'no price: ' || first_missing AS first_warning, round(a.capital - coalesce(invested, 0), 2) AS residual FROM acc a
    LEFT JOIN (SELECT account, count(*) AS n, sum(round(shares * price, 2)) AS invested FROM bought WHERE shares > 0 GROUP BY account) b ON b.account = a.account LEFT JOIN gone ON gone.account = a.account"""
)
def allocation_warnings(spark, sf_dir):
    """Accounts where some names have no price: one warning for each."""
    t = Tables(spark, sf_dir)
    latest = panel.latest_prices(t.prices("week")).filter("asset < 'Brand#2'")
    out = allocate.allocation_summary(_accounts(t), t.top10(), latest)
    return out.select("account", "n_bought", F.size("warnings").cast("long").alias("n_warnings"), F.get("warnings", F.lit(0)).alias("first_warning"), F.round("residual", 2).alias("residual"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two cap-based trackers, rebalanced monthly on rolling windows, did against their universes, net of 5 bps."""
    return risk_core(spark, sf_dir)


from . import artefacts, compared, fitted, wide  # noqa: E402, F401  (they register their queries)
