"""URL filters: rules by host and path, and a tree of path templates per host whose labelled purity decides the rest.

The tree grows level by level. At a node (a host and the template of the segments so far) a segment stays literal if it has at least ``min_rows`` urls and the share ``share`` of its node, so a
node has at most 1 / share literal branches; all other values are the wildcard ``*``. Then literal branches are put in order of their smoothed rate of bad labels and merged
with the branch before as long as a chi-square test tells neither their rates of bad labels nor their shares of urls that end there apart; what lies below merged branches grows together. Segments below ``depth`` levels are one leaf,
``**``. A template's purity is (good + strength * purity of its host) / (labelled + strength), that of a host leans on that of all hosts likewise, and templates below ``purity`` are rejected.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the longest that fits decides before the tree does.

Only counts are shuffled: urls are summed by host and path first, and after each level by what is left of the path, so a busy host or template is many small partial sums. Literal
branches have ``min_rows`` urls or more each, templates and hosts with rules are likewise few; they meet the urls by equality, broadcast by Spark where they are small enough and otherwise as joins
whose skewed parts adaptive execution splits.

Nulls: a null url, or one without ``://``, has an empty host and path, and is judged as the root of the empty host. A url without a path fits no rule with a path. Null labels don't count. Long urls
are read whole; equal urls are judged alike, each row for itself. An empty table gives no rows and an empty tree. A column of the user with the name of a result gives way to it; others, whatever their names, are kept. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The chi-square bound of one degree of freedom at 5 %.
BOUND = 3.841
RESULTS = ["host", "path", "rule", "template", "purity", "verdict"]


@dataclass
class Tree:
    """``levels``: per level (host, node, segment, branch), the literal branches. ``templates``: (host, template, urls, labelled, bad, purity)."""

    levels: list[DataFrame]
    templates: DataFrame
    purity: float


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def segments_of(path: Column) -> Column:
    """What stands after each ``/``; ``/a/`` has an empty last segment."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _quoted(segment: Column) -> Column:
    """A literal as it stands in a template, where ``*`` and ``|`` mean something."""
    return F.replace(F.replace(F.replace(segment, F.lit("%"), F.lit("%25")), F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C"))


def _similar(hits: str, of: str) -> str:
    """SQL: whether a chi-square test fails to tell the shares ``hits`` / ``of`` of two structs p and c apart."""
    a, n, b, m = (f"cast({s}.{f} as double)" for s, f in (("p", hits), ("p", of), ("c", hits), ("c", of)))
    square = f"({n} + {m}) * ({a} * ({m} - {b}) - {b} * ({n} - {a})) * ({a} * ({m} - {b}) - {b} * ({n} - {a}))"
    return f"{square} <= {BOUND} * {n} * {m} * ({a} + {b}) * ({n} + {m} - {a} - {b})"


def _merged_branches(literals: DataFrame) -> DataFrame:
    """(host, node, seg, urls, ends, labelled, bad) -> (host, node, segment, branch). A node has a bounded number of literals."""
    child = "struct(labelled, bad, urls, ends, array(seg) as segs)"
    kind = "array<struct<labelled: bigint, bad: bigint, urls: bigint, ends: bigint, segs: array<string>>>"
    both = "struct(p.labelled + c.labelled as labelled, p.bad + c.bad as bad, p.urls + c.urls as urls, p.ends + c.ends as ends, concat(p.segs, c.segs) as segs)"
    # p: the group before; a list of one or two groups takes its place
    joined = f"concat(slice(g, 1, size(g) - 1), flatten(transform(slice(g, -1, 1), p -> if({_similar('bad', 'labelled')} and {_similar('ends', 'urls')}, array({both}), array(p, c)))))"
    grown = f"aggregate(children, cast(array() as {kind}), (g, c) -> if(size(g) = 0, array(c), {joined}))"
    order = F.struct(((F.col("bad") + 1) / (F.col("labelled") + 2)).alias("rate"), "seg", F.expr(child).alias("child"))
    nodes = literals.groupBy("host", "node").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["child"]).alias("children"))
    groups = nodes.select("host", "node", F.explode(F.expr(grown)).alias("g"))
    label = F.array_join(F.transform(F.array_sort("g.segs"), _quoted), "|")
    return groups.select("host", "node", F.explode("g.segs").alias("segment"), label.alias("branch"))


def _stepped(rows: DataFrame, level: DataFrame) -> DataFrame:
    """``rows`` (host, node, rest, ...) one segment further down."""
    cols = [c for c in rows.columns if c not in ("host", "node", "rest")]
    seg = F.get("rest", F.lit(0))
    met = rows.withColumn("_seg", seg).join(level.select(F.col("host").alias("_host"), F.col("node").alias("_node"), F.col("segment").alias("_segment"), "branch"), F.expr("host = _host and node = _node and _seg = _segment"), "left")
    node = F.when(F.col("_seg").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.coalesce("branch", F.lit("*"))))
    return met.select("host", node.alias("node"), F.when(F.size("rest") > 0, F.slice("rest", F.lit(2), F.size("rest"))).otherwise(F.col("rest")).alias("rest"), *cols)


def _leaf(rows: DataFrame) -> DataFrame:
    return rows.withColumn("node", F.when(F.size("rest") > 0, F.concat("node", F.lit("/**"))).otherwise(F.col("node")))


def grow(urls: DataFrame, labelled: DataFrame, url: str = "url", bad: str = "bad", depth: int = 4, min_rows: int = 20, share: float = 0.02, strength: float = 10.0, purity: float = 0.5) -> Tree:
    """The tree of all ``urls`` (column ``url``), with the labels of ``labelled`` (``url`` and the boolean ``bad``)."""
    u = F.col(url)
    parts = [host_of(u).alias("host"), segments_of(path_of(u)).alias("rest")]
    zero, one = (F.lit(x).cast("long") for x in (0, 1))
    every = urls.select(*parts, one.alias("urls"), zero.alias("labelled"), zero.alias("bad"))
    known = labelled.filter(F.col(bad).isNotNull()).select(*parts, zero.alias("urls"), one.alias("labelled"), F.col(bad).cast("boolean").cast("long").alias("bad"))
    sums = [F.sum(c).alias(c) for c in ("urls", "labelled", "bad")]
    rows = table(every.unionByName(known).groupBy("host", F.lit("").alias("node"), "rest").agg(*sums))
    levels = []
    for _ in range(depth):
        ends = F.when(F.size("rest") == 1, F.col("urls")).otherwise(zero)
        counts = rows.filter(F.size("rest") > 0).withColumn("ends", ends).groupBy("host", "node", F.get("rest", F.lit(0)).alias("seg")).agg(*sums, F.sum("ends").alias("ends"))
        counts = table(counts)
        totals = counts.groupBy("host", "node").agg(F.sum("urls").alias("total"))
        literals = counts.filter(F.col("urls") >= min_rows).join(totals, ["host", "node"]).filter(F.col("urls") >= share * F.col("total")).drop("total")
        levels.append(table(_merged_branches(literals)))
        rows = table(_stepped(rows, levels[-1]).groupBy("host", "node", "rest").agg(*sums))
    leaves = _leaf(rows).groupBy("host", F.col("node").alias("template")).agg(*sums)
    leaves = table(leaves)
    total = leaves.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("labelled", "bad")]).first()
    base = (total["labelled"] - total["bad"]) / total["labelled"] if total["labelled"] else 1.0
    smoothed = lambda prior: (F.col("labelled") - F.col("bad") + strength * prior) / (F.col("labelled") + strength)
    hosts = leaves.groupBy("host").agg(*sums).select("host", smoothed(F.lit(base)).alias("prior"))
    return Tree(levels, table(leaves.join(hosts, "host").withColumn("purity", smoothed(F.col("prior"))).drop("prior")), purity)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) from a list."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def _fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules of itself and of the domains above it, the longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    name = F.concat("r_host", "r_path")
    listed = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    found = hosts.select("host", F.explode(suffixes).alias("suffix")).join(listed, F.col("suffix") == F.col("r_host"))
    rule = F.struct((-F.length(name)).alias("order"), name.alias("rule"), F.col("r_path").alias("path"), F.col("r_verdict").alias("verdict"))
    return found.groupBy(F.col("host").alias("f_host")).agg(F.sort_array(F.collect_set(rule)).alias("fits"))


def judge(pages: DataFrame, tree: Tree, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), template, purity and verdict (``allow`` or ``block``). ``rules``: host, path (from its ``/``) and verdict."""
    u = F.col(f"`{url}`")
    rows = packed(pages, host=host_of(u), path=path_of(u))
    rows = rows.select("host", F.lit("").alias("node"), segments_of(F.col("path")).alias("rest"), "path", "row")
    hosts = rows.select("host").distinct()
    for level in tree.levels:
        rows = _stepped(rows, level)
    judged = tree.templates.select(F.col("host").alias("t_host"), "template", "purity")
    rows = _leaf(rows).join(judged, F.expr("host = t_host and node = template"), "left")
    fits = table(_fitting_rules(hosts, rules))  # written: few rows, which Spark broadcasts, or else a join whose busy hosts it can split
    rows = rows.join(fits, F.col("host") == F.col("f_host"), "left")
    rule = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    rows = rows.withColumn("_rule", rule)
    own = F.when(F.col("purity") < tree.purity, "block").otherwise("allow")
    out = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("_rule.rule"), "template": F.col("node"), "purity": F.col("purity"), "verdict": F.coalesce("_rule.verdict", own)}
    left = [c for c in pages.columns if c.lower() not in RESULTS]
    return rows.select(*[F.col("row").getField(c).alias(c) for c in left], *[c.alias(name) for name, c in out.items()])
