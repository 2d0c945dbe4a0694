"""URL templates against a tree built in plain Python, planted bad templates, rules, and odd urls."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm import queries
from basketry.llm import url_filters as uf


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    return host, path


def far(a, n, b, m):
    a, n, b, m = map(float, (a, n, b, m))
    return (n + m) * (a * (m - b) - b * (n - a)) ** 2 > uf.BOUND * n * m * (a + b) * (n + m - a - b)


def tree(urls, labelled, depth=4, least=20, share=0.02, strength=10.0):
    """(host, path) -> template, and (host, template) -> purity."""
    rows = [[*parts(u), None] for u in urls] + [[*parts(u), bad] for u, bad in labelled]
    at = [("", p.split("/")[1:]) for _, p, _ in rows]
    for _ in range(depth):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, 0]))
        for (host, _, bad), (node, rest) in zip(rows, at, strict=True):
            if rest:
                c = nodes[host, node][rest[0]]
                if bad is None:
                    c[0] += 1
                    c[3] += len(rest) == 1
                else:
                    c[1] += 1
                    c[2] += bad
        names = {}
        for node, segs in nodes.items():
            total = sum(c[0] for c in segs.values())
            kept = sorted(((c[2] + 1) / (c[1] + 2), s, c) for s, c in segs.items() if c[0] >= least and c[0] >= share * total)
            groups = []
            for _, s, c in kept:
                if groups and not far(groups[-1][1][2], groups[-1][1][1], c[2], c[1]) and not far(groups[-1][1][3], groups[-1][1][0], c[3], c[0]):
                    groups[-1] = ([*groups[-1][0], s], [x + y for x, y in zip(groups[-1][1], c, strict=True)])
                else:
                    groups.append(([s], c))
            for members, _ in groups:
                label = "|".join(m.replace("%", "%25").replace("*", "%2A").replace("|", "%7C") for m in sorted(members))
                names.update({(node, m): label for m in members})
        at = [(n + "/" + names.get(((h, n), r[0]), "*"), r[1:]) if r else (n, r) for (h, _, _), (n, r) in zip(rows, at, strict=True)]
    ends = [n + "/**" if r else n for n, r in at]
    good, known, hosts = Counter(), Counter(), defaultdict(lambda: [0, 0])
    for (h, _, bad), t in zip(rows, ends, strict=True):
        good[h, t] += bad is False
        known[h, t] += bad is not None
        hosts[h][0] += bad is False
        hosts[h][1] += bad is not None
    n = sum(k for _, k in hosts.values())
    base = sum(g for g, _ in hosts.values()) / n if n else 1.0
    prior = {h: (g + strength * base) / (k + strength) for h, (g, k) in hosts.items()}
    purity = {(h, t): (good[h, t] + strength * prior[h]) / (known[h, t] + strength) for h, t in good}
    return {(h, p): t for (h, p, _), t in zip(rows, ends, strict=True)}, purity


def crawl(rng, n):
    """Urls of one busy host and others, and labels: one section and one file type are bad."""
    urls, labels = [], []
    for i in range(n):
        host = rng.choice(["Big.example.org"] * 6 + ["a.example.org", "b.example.com", "rare.example.net"] + [f"h{rng.randrange(40)}.example.org"])
        section = rng.choice(["news", "shop", "blog", "win*now", "a|b", f"u{i}"])
        tail = rng.choice([f"/{i}", f"/{i}.html", f"/x/{i % 7}/{i}/deep/er", "/", ""])
        url = f"{rng.choice(['http', 'https'])}://{host}/{section}{tail}" + rng.choice(["", "?a=/b", "#c/d"])
        urls.append(url)
        if rng.random() < 0.5:
            labels.append((url, rng.random() < (0.9 if section == "win*now" else 0.05)))
    return urls, labels


RULES = [("com", "/", "allow"), ("example.com", "/shop/", "block"), ("b.example.com", "/shop/x", "allow"), ("le.com", "/", "block")]


def test_tree_by_plain_python(spark):
    urls, labels = crawl(random.Random(4), 4000)
    urls += [None, "", "no scheme/at all", "http://", "https://HOST.É.org", "ftp://x.com?/shop/", "http://b.example.com/shop/xyz", "a://b.example.com/news/1\n2", "http://" + "long." * 3000 + "com/" + "s/" * 5000, urls[0], urls[0]]
    pages = spark.createDataFrame([(u, i, "old", "r") for i, u in enumerate(urls)], "url string, id int, host string, row string")
    known = spark.createDataFrame([*labels, (urls[1], None)], "url string, bad boolean")
    grown = uf.grow(pages, known)
    got = uf.judge(pages, grown, uf.rule_table(spark, RULES)).collect()
    template, purity = tree(urls, labels)
    assert len(got) == len(urls) and got[0].asDict().keys() == {"url", "id", "row", *uf.RESULTS}
    blocked = Counter()
    for r in got:
        host, path = parts(urls[r["id"]])
        assert (r["host"], r["path"], r["template"], r["row"]) == (host, path, template[host, path], "r")
        assert r["purity"] == pytest.approx(purity[host, template[host, path]], abs=1e-12)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if r["purity"] < 0.5 else "allow")
        assert (r["rule"], r["verdict"]) == (rule, verdict)
        if rule is None:
            blocked[verdict, "/win*now" in path] += 1
    # the planted section is blocked, nearly nothing else is
    assert blocked["block", True] > 0.8 * (blocked["block", True] + blocked["allow", True]) and blocked["block", False] < 0.02 * blocked["allow", False]


def test_templates_merge_and_generalise(spark):
    urls = [f"http://h.org/{lang}/{i}.html" for lang in ("de", "en", "fr") for i in range(60)]
    labels = [(u, False) for u in urls if "/fr/" not in u] + [(u, True) for u in urls if "/fr/" in u]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    grown = uf.grow(pages, spark.createDataFrame(labels, "url string, bad boolean"))
    assert {r["template"]: r["urls"] for r in grown.templates.collect()} == {"/de|en/*": 120, "/fr/*": 60}
    got = uf.judge(pages, grown, uf.rule_table(spark, [("none.org", "/", "allow")])).groupBy("verdict").agg(F.count("*").alias("n"), F.count("rule").alias("r")).collect()
    assert {tuple(r) for r in got} == {("allow", 120, 0), ("block", 60, 0)}


def test_empty_tables(spark):
    pages, known = spark.createDataFrame([], "url string"), spark.createDataFrame([], "url string, bad boolean")
    grown = uf.grow(pages, known)
    assert grown.templates.count() == 0 and uf.judge(pages, grown, uf.rule_table(spark, RULES)).count() == 0
    one = spark.createDataFrame([("http://a.b/c",)], "url string")
    assert uf.judge(one, uf.grow(one, known), uf.rule_table(spark, RULES)).collect()[0]["verdict"] == "allow"


def test_query_has_no_python_in_its_plan(spark):
    plan = queries.op12_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
