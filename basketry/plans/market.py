"""The library's tables (prices, benchmark, caps, cash, factors, ...) as derived from TPC-H-like tables.

A region is a universe, a brand an asset; its price is the volume-weighted average price of its lines up to a period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, asset: str = "p_brand") -> DataFrame:
    """(universe, asset, d, e, q, tax, size, retail): one row per line item."""
    t = lambda n: read(spark, sf_dir, n)
    rows = t("lineitem").join(t("part"), F.expr("l_partkey = p_partkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
    rows = rows.join(t("nation"), F.expr("s_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return rows.select(
        F.col("r_name").alias("universe"), F.col(asset).alias("asset"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_extendedprice").alias("e"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("tax"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retail")
    )


def period(freq: str):
    return F.to_date(F.date_trunc(freq, "d"))


def totals(rows: DataFrame, freq: str) -> DataFrame:
    """(universe, dt, asset) with sums of e and q (all lines, and those of small, big, dear and cheap parts), of tax, and the lines' number.

    Prices, benchmark, cash and factors are roll-ups of this table, so one scan of the lines serves them all.
    """
    sides = {"s": F.col("size") <= 25, "b": F.col("size") > 25, "h": F.col("retail") >= 950, "l": F.col("retail") < 950}
    split = [F.sum(F.when(when, F.col(c))).alias(f"{c}_{k}") for k, when in sides.items() for c in ("e", "q")]
    return rows.groupBy("universe", period(freq).alias("dt"), "asset").agg(F.sum("e").alias("e"), F.sum("q").alias("q"), F.sum("tax").alias("tax"), F.count("tax").alias("n"), *split)


def prices(each: DataFrame) -> DataFrame:
    """(universe, dt, asset, price, cap) from sums e and q by period: averaged into the price so far; cap is the period's own value."""
    by = Window.partitionBy("universe", "asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("universe", "dt", "asset", (F.sum("e").over(by) / F.sum("q").over(by)).alias("price"), F.col("e").alias("cap"))


def benchmark(each: DataFrame) -> DataFrame:
    """(universe, dt, price): the average price so far over all lines of a universe."""
    whole = each.groupBy("universe", "dt").agg(F.sum("e").alias("e"), F.sum("q").alias("q"))
    return prices(whole.withColumn("asset", F.lit("index"))).drop("asset", "cap")


def benchmark_returns(each: DataFrame) -> DataFrame:
    return panel.simple_returns(benchmark(each).withColumn("asset", F.lit("index"))).select("universe", "dt", "r")


def _rate() -> Column:
    return F.sum("tax") / F.sum("n") / 252


def cash(each: DataFrame) -> DataFrame:
    """(dt, r)."""
    return each.groupBy("dt").agg(_rate().alias("r"))


def factors(each: DataFrame) -> DataFrame:
    """(dt, mkt_rf, smb, hml, rf): the market, small less big parts, dear less cheap parts, and cash."""
    price = lambda k: F.sum(f"e{k}") / F.sum(f"q{k}")
    side = each.groupBy("dt").agg(price("").alias("m"), *[price(f"_{k}").alias(k) for k in "sbhl"], _rate().alias("rf"))
    by = Window.orderBy("dt")  # one row per period
    r = lambda c: F.col(c) / F.lag(c).over(by) - 1
    return side.select("dt", (r("m") - F.col("rf")).alias("mkt_rf"), (r("s") - r("b")).alias("smb"), (r("h") - r("l")).alias("hml"), "rf").dropna()


def membership(each: DataFrame, least: int = 1) -> DataFrame:
    """(universe, dt, asset) of the assets with ``least`` lines in the period, from the sums of :func:`totals`."""
    return each.filter(F.col("n") >= least).select("universe", "dt", "asset")


# Stress windows of the tables' time span.
REGIMES = (
    ("early_calm", "EC", "calm", "1995-03-01", "1995-12-01"),
    ("spring_96", "S96", "stress", "1996-02-01", "1996-09-01"),
    ("turn_97", "T97", "calm", "1997-01-01", "1997-12-31"),
    ("summer_98", "S98", "stress", "1998-05-01", "1999-01-01"),
    ("rise_99", "R99", "rally", "1999-01-01", "1999-12-31"),
    ("peak_00", "P00", "rally", "1999-10-01", "2000-06-01"),
    ("fall_00", "F00", "stress", "2000-04-01", "2001-01-01"),
    ("last_01", "L01", "stress", "2001-01-01", "2001-11-01"),
)


def regimes(spark: SparkSession, windows: tuple = REGIMES) -> DataFrame:
    rows = spark.createDataFrame(windows, "regime string, short string, type string, start string, stop string")
    return rows.select("regime", "short", "type", F.to_date("start").alias("start_dt"), F.to_date("stop").alias("end_dt"))
