"""Files: parsing, round trips and fallbacks."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketry.sources import files


def lines(spark, text):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(text.split("\n"))], "file string, line long, value string")


def test_universe_round_trip(spark, tmp_path):
    assets = spark.createDataFrame([("AA",), ("BB",)], "asset string")
    files.write_universe(assets, f"file://{tmp_path}/u")
    assert sorted(r[0] for r in files.read_universe(spark, f"file://{tmp_path}/u").collect()) == ["AA", "BB"]


def test_holdings_skip_preamble(spark):
    text = 'Fund,"x"\nAs of,today\n\nTicker,Name,Asset Class\nAAA,"A, Inc",Equity\nBBB,B,Bond\n'
    got = [(r["asset"], r["name"], r["class"]) for r in files.holdings(lines(spark, text)).orderBy("line").collect()]
    assert got == [("AAA", "A, Inc", "Equity"), ("BBB", "B", "Bond")]


def test_factors_stop_at_the_annual_section(spark):
    text = "notes\n,Mkt-RF,SMB,HML,RF\n20200102, 1.0, 0.5, -0.2, 0.01\n20200103, , 0.5, -0.2, 0.01\n\nAnnual Factors\n20201231, 9, 9, 9, 9"
    got = files.parse_factors(lines(spark, text)).collect()
    assert len(got) == 1 and abs(got[0]["mkt_rf"] - 0.01) < 1e-12


def test_html_constituents(spark):
    html = "<table><tr><th>A</th></tr></table><table><tr><th>Name</th><th>Symbol</th></tr><tr><td>x</td><td><a href='q'>BRK.B</a></td></tr><tr><td>y</td><td>MS[a]</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    assert [(r["page_id"], r["symbol"]) for r in files.html_constituents(pages).orderBy("pos").collect()] == [(1, "BRK.B"), (1, "MS[a]")]


def test_static_fallback(spark):
    some, static = spark.createDataFrame([("a",)], "asset string"), spark.createDataFrame([("s",)], "asset string")
    assert [r[0] for r in files.or_static(some, static, 2).collect()] == ["s"]
    assert [r[0] for r in files.or_static(some, static, 1).collect()] == ["a"]


def test_caps_round_trip_legacy_and_corrupt(spark, tmp_path):
    caps = spark.createDataFrame([("A", 1.5), ("B", None)], "asset string, cap double")
    files.write_caps(caps, f"file://{tmp_path}/c", "test", "2024-01-01T00:00:00Z")
    assert {r["asset"]: r["cap"] for r in files.read_caps(spark, f"file://{tmp_path}/c").collect()} == {"A": 1.5, "B": None}
    (tmp_path / "flat.json").write_text('{"A": 2.0, "B": null}')
    assert {r["asset"]: r["cap"] for r in files.read_caps(spark, f"file://{tmp_path}/flat.json").collect()} == {"A": 2.0, "B": None}
    (tmp_path / "bad.json").write_text("{oops")
    assert files.read_caps(spark, f"file://{tmp_path}/bad.json").count() == 0


def test_price_panel_roles(spark):
    wide = spark.createDataFrame([("2020-01-01", 1.0, 2.0, 9.0), ("2020-01-02", 1.1, None, 9.1)], "dt string, A double, B double, IDX double")
    out = files.price_panel(wide, "U", "IDX")
    assert {r["asset"] for r in out["prices"].collect()} == {"A"} and out["benchmark"].count() == 2


def test_factor_columns_are_found_by_name(spark):
    text = ["19990101, 1, 1, 1, 1", "This file,", ", RF , SMB,Mkt-RF,HML", "", "20000103, 0.01, 1, 2, x", "20000104, 0.02, 1, 2, 3", "  20000105 ,0.03,4,5,6", "", "20000106, 9, 9, 9, 9"]
    got = files.parse_factors(lines(spark, "\n".join(text))).orderBy("dt").collect()
    assert [(str(r["dt"]), r["mkt_rf"], r["smb"], r["hml"], r["rf"]) for r in got] == [("2000-01-04", 0.02, 0.01, 0.03, 0.0002), ("2000-01-05", 0.05, 0.04, 0.06, 0.0003)]
    assert files.parse_factors(lines(spark, "\n".join(text[:2]))).count() == 0


def test_a_failed_write_leaves_the_old_list(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    files.write_universe(spark.createDataFrame([("AA",), ("BB",)], "asset string"), path)
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("lost"))).alias("asset"))
    with pytest.raises(Exception, match="lost"):
        files.write_universe(broken, path)
    assert sorted(r[0] for r in files.read_universe(spark, path).collect()) == ["AA", "BB"]
    assert [p.name for p in tmp_path.iterdir()] == ["u"]
    files.write_universe(spark.createDataFrame([("CC",)], "asset string"), path)
    assert [r[0] for r in files.read_universe(spark, path).collect()] == ["CC"] and [p.name for p in tmp_path.iterdir()] == ["u"]


KILLED = """
import os, sys
from basketry.session import session
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketry.sources import files
spark = session("killed", "local[1]", spark__ui__enabled="false")
renamed = files._renamed
def once(fs, old, new):
    if old.getName().startswith(".u.staged"):
        os.kill(os.getpid(), 9)  # the old list has moved aside, the new one has not moved in
    renamed(fs, old, new)
files._renamed = once
files.write_universe(spark.createDataFrame([("NEW",)], "asset string"), sys.argv[1])
"""


def test_a_writer_killed_between_the_renames_leaves_the_old_list(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    files.write_universe(spark.createDataFrame([("OLD",)], "asset string"), path)
    ended = subprocess.run([sys.executable, "-c", KILLED, path], cwd=Path(__file__).parent.parent, capture_output=True, timeout=120)
    assert ended.returncode == -9 and not (tmp_path / "u").exists()
    assert [r[0] for r in files.read_universe(spark, path).collect()] == ["OLD"]
    files.write_universe(spark.createDataFrame([("NEXT",)], "asset string"), path)
    assert [r[0] for r in files.read_universe(spark, path).collect()] == ["NEXT"] and (tmp_path / "u").exists() and not (tmp_path / ".u.before").exists()


def test_html_grid_with_spans_nesting_and_entities(spark):
    html = """<p>x</p><table class=info><tr><td>Symbol<table><tr><th>Inner</th></tr><tr><td>Q</td></tr></table></td></tr></table>
    <table><thead><tr><th rowspan="2">Name</th><th colspan=2>Listing</th></tr><tr><th>Symbol</th><th>Since</th></tr></thead>
    <tbody><tr><td>A &amp; B<td rowspan=2>AB&#46;X<td>1999<tr><td>A &lt;2&gt;</td><td>2001</td></tr>
    <!-- <tr><td>no</td></tr> --><tr><td>C<script>var t = "</td>";</script></td><td><a href='c'>C<br>D</a> [b]</td><td></td></tr><tr><td colspan="2">both</td><td>n</td></tr><tr><td rowspan=0>z</td><td>&eacute;</td></tr></table>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>open"), (4, "<table></table>")], "page_id long, html string")
    grid = {(r["page_id"], r["t"], r["row"], r["col"]): (r["text"], r["head"]) for r in files.html_tables(pages).collect()}
    assert grid[1, 0, 0, 0] == ("Symbol", False) and grid[1, 1, 0, 0] == ("Inner", True) and grid[1, 1, 1, 0] == ("Q", False)
    table = [[grid.get((1, 2, r, c), ("-",))[0] for c in range(3)] for r in range(7)]
    assert table == [["Name", "Listing", "Listing"], ["Name", "Symbol", "Since"], ["A & B", "AB.X", "1999"], ["A <2>", "AB.X", "2001"], ["C", "C D [b]", ""], ["both", "both", "n"], ["z", "é", "-"]]
    assert grid[3, 0, 0, 0] == ("open", False) and {k[0] for k in grid} == {1, 3}
    # the first table with the heading in a heading row: a first row counts as one
    assert files.html_constituents(pages.filter("page_id <> 1")).count() == 0
    last = spark.createDataFrame([(1, html[html.index("<table><thead") :])], "page_id long, html string")
    assert [(r["pos"], r["symbol"]) for r in files.html_constituents(last).orderBy("pos").collect()] == [(2, "AB.X"), (3, "AB.X"), (4, "C D [b]"), (5, "both"), (6, "é")]
