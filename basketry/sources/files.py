"""Sources and sinks: price downloads, universe lists, pages, caps, factors, run artefacts.

Readers take paths or DataFrames of lines and return tables. Sinks write beside their target and swap by rename (:func:`replaced`), so a write that fails leaves what was there.
"""

from __future__ import annotations

import re
import uuid
from html.parser import HTMLParser

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

# The fields of a cap snapshot, of a factor table, and the names of its columns in published files.
CAPS = "fetched_at_utc string, source string, caps map<string, double>"
FACTORS = "dt date, mkt_rf double, smb double, hml double, rf double"
FACTOR_NAMES = {"Mkt-RF": "mkt_rf", "SMB": "smb", "HML": "hml", "RF": "rf"}


# ---- safe overwrite --------------------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    """The path, its file system, and the path that is its spare copy while a new one takes its place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    spare = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.before")
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration()), spare


def _renamed(files, old, new) -> None:
    if not files.rename(old, new):
        raise OSError(f"can't rename {old} to {new}")


def standing(spark: SparkSession, path: str) -> str:
    """Where the last finished write of ``path`` is: at ``path``, or beside it if a writer was lost between the two renames of its swap."""
    place, files, spare = _hadoop(spark, path)
    return spare.toString() if not files.exists(place) and files.exists(spare) else path


def replaced(spark: SparkSession, path: str, write) -> None:
    """``write(staged)`` writes a folder beside ``path``; when it has finished, it takes the place of ``path``.

    Spark's own overwrite removes the old files before it writes. Here the old ones stay until the new ones are whole: the target is renamed to a spare, the staged folder to the target, and the
    spare is removed. A failed write leaves the target as it was and removes what was staged. A writer that is lost between the two renames leaves the spare, which
    :func:`standing` finds and the next write puts back first. One writer at a time.
    """
    place, files, spare = _hadoop(spark, path)
    if files.exists(spare):
        if files.exists(place):
            files.delete(spare, True)  # the swap was done, but for its last step
        else:
            _renamed(files, spare, place)
    staged = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.staged-{uuid.uuid4().hex}")
    try:
        write(staged.toString())
        if files.exists(place):
            _renamed(files, place, spare)
        try:
            _renamed(files, staged, place)
        except (OSError, Py4JJavaError):
            if files.exists(spare):
                _renamed(files, spare, place)
            raise
        files.delete(spare, True)
    finally:
        files.delete(staged, True)


# ---- prices and universes --------------------------------------------------------------------------


def price_field(close: str = "close", adjusted: str = "adj_close") -> Column:
    """The adjusted close where there is one, else the close."""
    return F.coalesce(F.col(adjusted), F.col(close))


def price_panel(wide: DataFrame, universe: str, benchmark: str, cash: str | None = None, dt: str = "dt") -> dict[str, DataFrame]:
    """A wide price table (a column per ticker) as long tables: prices of complete assets, benchmark, and cash."""
    assets = [c for c in wide.columns if c != dt]
    quoted = ", ".join(f"'{c}', cast(`{c}` as double)" for c in assets)
    long = wide.select(F.col(dt).cast("date").alias("dt"), F.expr(f"stack({len(assets)}, {quoted}) as (asset, price)")).withColumn("universe", F.lit(universe))
    from ..operators.panel import complete_assets

    roles = [benchmark] + ([cash] if cash else [])
    out = {"prices": complete_assets(long.filter(~F.col("asset").isin(roles)), "price"), "benchmark": long.filter(F.col("asset") == benchmark).select("universe", "dt", "price")}
    if cash:
        out["cash"] = long.filter(F.col("asset") == cash).select("dt", "price")
    return out


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(asset): one ticker per line, with or without a header."""
    return spark.read.text(standing(spark, path)).select(F.trim("value").alias("asset")).filter("asset <> '' and lower(asset) <> 'ticker'")


def write_universe(assets: DataFrame, path: str) -> None:
    replaced(assets.sparkSession, path, lambda to: assets.select(F.col("asset").alias("ticker")).write.option("header", True).csv(to))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label) of every link of a page, in order."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))).alias("pos", "a"))
    return found.select("page_id", "pos", F.regexp_extract("a", r'(?is)href="([^"]*)"', 1).alias("href"), F.regexp_replace("a", r"<[^>]*>", "").alias("label"))


class _Tables(HTMLParser):
    """The cells of a page's tables in the order of their rows: (table, row, text, rowspan, colspan, is it a head). Tables inside cells are tables of their own; entities are read as what they stand for."""

    SILENT = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.open, self.count, self.silent = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "table":
            self.open.append({"table": self.count, "row": -1, "cell": None, "head": False})
            self.count += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._close(t)
                t["row"] += 1
            elif tag in ("thead", "tbody", "tfoot"):
                self._close(t)
                t["head"] = tag == "thead"
            elif tag in ("td", "th"):
                self._close(t)
                t["row"] = max(t["row"], 0)  # a cell outside any row
                spans = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and v and re.fullmatch(r"\d{1,4}", v)}
                t["cell"] = [t["table"], t["row"], [], spans.get("rowspan", 1), max(spans.get("colspan", 1), 1), tag == "th" or t["head"]]
            elif tag == "br" and t["cell"]:
                t["cell"][2].append(" ")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(self.silent - 1, 0)
        elif self.open and tag in ("td", "th", "tr", "table", "thead", "tbody", "tfoot"):
            self._close(self.open[-1])
            if tag == "table":
                self.open.pop()
            elif tag == "thead":
                self.open[-1]["head"] = False

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] and not self.silent:
            self.open[-1]["cell"][2].append(data)

    def _close(self, t):
        if t["cell"]:
            t["cell"][2] = " ".join("".join(t["cell"][2]).split())
            self.cells.append(t["cell"])
            t["cell"] = None

    def close(self):
        super().close()
        while self.open:
            self._close(self.open.pop())


def _grid(html: str | None) -> list[dict]:
    """Every place of every table that a cell covers: a cell with spans covers several. Rows of a span end with their table; ``rowspan=0`` goes to its end."""
    reader = _Tables()
    reader.feed(html or "")
    reader.close()
    out, taken, at = [], {}, {}
    last = {}
    for t, row, *_ in reader.cells:
        last[t] = max(last.get(t, 0), row)
    for t, row, text, down, across, head in sorted(reader.cells, key=lambda c: (c[0], c[1])):
        col = at.get((t, row), 0)
        while (t, row, col) in taken:
            col += 1
        end = last[t] + 1 if down == 0 else min(row + down, last[t] + 1)
        for r in range(row, end):
            for c in range(col, col + across):
                if (t, r, c) not in taken:
                    taken[t, r, c] = True
                    out.append({"t": t, "row": r, "col": c, "text": text, "head": head})
        at[t, row] = col + across
    return out


CELLS = "array<struct<t: int, row: int, col: int, text: string, head: boolean>>"


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, t, row, col, text, head): the tables of each page as grids, with every cell at all places that its rowspan and colspan cover.

    Tables inside cells count as tables of their own, numbered in the order of their tags, and their text is not the outer cell's. Missing end tags, entities, comments and scripts are read as browsers do.
    """
    kind = pa.list_(pa.struct([("t", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("head", pa.bool_())]))

    def read(pages: pa.Array) -> pa.Array:
        return pa.array([_grid(p.as_py()) for p in pages], kind)

    ship(pages.sparkSession)
    return pages.select("page_id", F.arrow_udf(read, CELLS)("html").alias("cells")).select("page_id", F.inline("cells"))


def html_constituents(pages: DataFrame, headers: tuple[str, ...] = ("ticker", "symbol")) -> DataFrame:
    """(page_id, pos, symbol): the matching column of each page's first table that has one of ``headers`` in a heading row.

    Heading rows are the first row and those after it that have heads only. ``pos`` is the row of the table; a symbol that spans rows stands in each of them.
    """
    cells = html_tables(pages)
    rows = cells.groupBy("page_id", "t", "row").agg(F.bool_and("head").alias("heads"), F.array_agg(F.struct("col", "text")).alias("cells"))
    order = Window.partitionBy("page_id", "t").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heading", F.min((F.col("heads") | (F.col("row") == 0)).cast("int")).over(order) == 1)
    named = rows.filter("heading").select("page_id", "t", F.inline("cells")).filter(F.lower("text").isin(*headers))
    first = named.groupBy("page_id").agg(F.min(F.struct("t", "col")).alias("f")).select("page_id", "f.t", "f.col")
    body = rows.filter("not heading").select("page_id", "t", F.col("row").alias("pos"), F.inline("cells"))
    return body.join(first, ["page_id", "t", "col"]).select("page_id", "pos", F.col("text").alias("symbol")).filter("symbol <> ''")


def holdings(lines: DataFrame, first_column: str = "Ticker") -> DataFrame:
    """(file, line, asset, name, class) from lines (file, line, value) of a CSV with a preamble before its header."""
    head = F.col("value").startswith(first_column + ",")
    by = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    body = lines.withColumn("seen", F.coalesce(F.max(head).over(by), F.lit(False))).filter(F.col("seen") & ~head & (F.trim("value") != ""))
    parsed = body.withColumn("c", F.from_csv("value", "asset string, name string, class string"))
    return parsed.select("file", "line", "c.*").filter("asset is not null")


def or_static(parsed: DataFrame, static: DataFrame, least: int = 45) -> DataFrame:
    """``parsed`` if it has ``least`` rows, else ``static``. No more than ``least`` rows are counted to tell."""
    return parsed if parsed.limit(least).count() >= least else static


# ---- market caps -----------------------------------------------------------------------------------


def read_caps(spark: SparkSession, path: str) -> DataFrame:
    """(asset, cap) of a snapshot {fetched_at_utc, source, caps: {..}} or of the older flat form; a corrupt file is empty."""
    text = spark.read.option("wholetext", True).text(standing(spark, path))
    nested = F.from_json("value", CAPS)["caps"]
    flat = F.map_filter(F.from_json("value", "map<string, string>"), lambda k, v: ~k.isin("fetched_at_utc", "source", "caps"))
    return text.select(F.explode(F.coalesce(nested, F.transform_values(flat, lambda k, v: v.try_cast("double")))).alias("asset", "cap"))


def write_caps(caps: DataFrame, path: str, source: str, fetched_at: str) -> None:
    """One snapshot with its provenance; caps are a map, as readers of the file expect."""
    packed = caps.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("asset", "cap")))).alias("caps"))
    one = packed.select(F.lit(fetched_at).alias("fetched_at_utc"), F.lit(source).alias("source"), "caps").coalesce(1)
    replaced(caps.sparkSession, path, lambda to: one.write.option("ignoreNullFields", False).json(to))


# ---- factors ---------------------------------------------------------------------------------------


def parse_factors(lines: DataFrame) -> DataFrame:
    """(dt, mkt_rf, smb, hml, rf) in fractions from lines (file, line, value): the daily section of each file.

    The header is the first line of the file that names all four factors; columns are taken by those names, in any order. The section is what follows without
    a break: it ends at the first line behind a dated one that does not begin with a date of eight digits. A file without a header gives nothing; a row with a value that is no number is dropped.
    """
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    place = F.filter(F.array(*[F.array_position("cells", n) for n in FACTOR_NAMES]), lambda p: p > 0)
    rows = lines.withColumn("cells", cells)
    heads = rows.filter(F.size(place) == len(FACTOR_NAMES)).groupBy("file").agg(F.min_by(F.struct(F.col("line").alias("head"), F.col("cells").alias("names")), "line").alias("h")).select("file", "h.*")
    body = rows.join(heads, "file").filter("line > head").withColumn("dated", F.get("cells", F.lit(0)).rlike(r"^\d{8}$"))
    first = body.filter("dated").groupBy("file").agg(F.min("line").alias("first"))
    ended = body.join(first, "file").filter("not dated and line > first").groupBy("file").agg(F.min("line").alias("stop"))
    daily = body.filter("dated").join(ended, "file", "left").filter("stop is null or line < stop")
    number = lambda n: F.get("cells", (F.array_position("names", n) - 1).cast("int")).try_cast("double") / 100
    return daily.select(F.to_date(F.get("cells", F.lit(0)), "yyyyMMdd").alias("dt"), *[number(n).alias(c) for n, c in FACTOR_NAMES.items()]).dropna()


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTORS).option("header", True).csv(standing(spark, path))


def write_factors(factors: DataFrame, path: str) -> None:
    replaced(factors.sparkSession, path, lambda to: factors.select("dt", "mkt_rf", "smb", "hml", "rf").write.option("header", True).csv(to))


# ---- artefacts -------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Training arrays and run tables, partitioned by ``by``."""
    replaced(df.sparkSession, path, lambda to: (df.write.partitionBy(*by) if by else df.write).parquet(to))


def run_maps(nav: DataFrame, value: str = "nav") -> DataFrame:
    """(universe, method, curve): a run's series as a map from date text to value."""
    entry = F.struct(F.date_format("dt", "yyyy-MM-dd").alias("k"), F.col(value).alias("v"))
    return nav.groupBy("universe", "method").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("curve"))


def run_artefact(run: dict, config: dict, metrics: DataFrame | None = None) -> DataFrame:
    """One self-describing record per universe of a walk-forward run: config, counts, dates, curves, turnover, costs, benchmark and metrics as maps.

    ``run``: what the walk-forward plan returns; ``metrics``: universe, method and numbers. Maps hold one entry per date or method.
    """
    day = F.date_format("rebal_dt", "yyyy-MM-dd")
    maps = lambda rows, value: rows.groupBy("universe", "method").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(day.alias("k"), F.col(value).alias("v"))))).alias("m"))
    by_method = lambda rows, name: rows.groupBy("universe").agg(F.map_from_entries(F.collect_list(F.struct("method", "m"))).alias(name))
    reb = run["rebalances"]
    counts = run["nav"].groupBy("universe").agg(F.countDistinct("dt").alias("n_dates"), F.countDistinct("method").alias("n_methods"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    dates = run["weights"].groupBy("universe").agg(F.sort_array(F.collect_set(day)).alias("rebalance_dates"))
    bench = run_maps(run["bench"].withColumn("method", F.lit("benchmark"))).select("universe", F.col("curve").alias("benchmark_curve"))
    out = counts.join(dates, "universe").join(bench, "universe")
    parts = {"equity_curves": run_maps(run["nav"]).withColumnRenamed("curve", "m"), "turnover": maps(reb, "turnover"), "transaction_costs": maps(reb, "cost")}
    if metrics is not None:
        names = [c for c in metrics.columns if c not in ("universe", "method")]
        pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))
        parts["risk_metrics"] = metrics.select("universe", "method", pairs.alias("m"))
    for name, rows in parts.items():
        out = out.join(by_method(rows, name), "universe", "left")
    settings = F.map_from_arrays(F.array(*map(F.lit, config)), F.array(*[F.lit(str(v)) for v in config.values()]))
    info = F.struct("n_dates", "n_methods", "first_dt", "last_dt", F.size("rebalance_dates").alias("n_rebalances"))
    return out.select("universe", settings.alias("config"), info.alias("metadata"), "rebalance_dates", *parts, "benchmark_curve", F.lit(run["survivorship_bias"]).alias("survivorship_bias_flag"))


def write_records(df: DataFrame, path: str) -> None:
    """Nested records as JSON lines, nulls included."""
    replaced(df.sparkSession, path, lambda to: df.write.option("ignoreNullFields", False).json(to))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(standing(spark, path))


def active_holdings(weights: DataFrame) -> DataFrame:
    return weights.filter("w > 0").orderBy(F.desc("w"), "asset")


def write_active(weights: DataFrame, path: str) -> None:
    """Weights above 0, the largest first, as one CSV file: a portfolio's holdings are few."""
    replaced(weights.sparkSession, path, lambda to: active_holdings(weights).coalesce(1).write.option("header", True).csv(to))


def compact(results: DataFrame, names: dict[str, str]) -> DataFrame:
    """Selected fields of nested results under new names."""
    return results.select(*[F.col(old).alias(new) for old, new in names.items()])


def sanitized(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, in every floating column."""
    inf = float("inf")
    fix = lambda c: F.when(~F.isnan(c) & ~F.col(c).isin(inf, -inf), F.col(c))
    return df.withColumns({c: fix(c) for c, kind in df.dtypes if kind in ("double", "float")})
