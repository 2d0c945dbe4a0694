"""The pipeline's stages on the smallest tables: columns, effects and what is left."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from basketry.llm.near_dedup import near_dedup
from basketry.llm.twins import oracle_sql
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_llm import mixed_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, counts = docs.columns, [docs.count()]
    from basketry.llm.common import table

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, SF))
        assert docs.columns == cols, name
        counts.append(docs.count())
        if name == "near dedup":
            assert near_dedup(docs).filter("not kept").count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] != counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == counts[4]


def kept_by_brute_force(texts, percent):
    """The least id of every component of texts that are ``percent`` similar on shingles of five words."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= percent * (len(a) + len(b) - k):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return sorted({find(i) for i in ids})


def test_near_stage_links_from_80_percent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = []
    for n, percent in enumerate((79, 80, 82, 84, 85)):  # the second text has so many of the first one's 100 shingles
        words = [f"p{n}w{i}" for i in range(104)]
        rows += [(10**9 + 2 * n, " ".join(words)), (10**9 + 2 * n + 1, " ".join(words[: percent + 4]))]
    planted = docs.limit(1).drop("doc_id", "text").crossJoin(spark.createDataFrame(rows, "doc_id long, text string")).select(*docs.columns)
    all_docs = docs.unionByName(planted)
    texts = {r["doc_id"]: r["text"] for r in all_docs.select("doc_id", "text").collect()}
    got = sorted({r["doc_id"] for r in corpus_pipeline.near(spark, all_docs, SF).select("doc_id").collect()})
    assert got == kept_by_brute_force(texts, 80)
    assert [i - 10**9 for i in got if i >= 10**9] == [0, 1, 2, 4, 6, 8]


CLASH = ["row", "_word", "_mask", "_slot", "id", "size", "copies", "kept", "n_words", "place", "words", "open", "n", "tie", "spans", "Title"]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, and extra columns whose names the stages use themselves."""
    from basketry.llm.common import table

    words = "the of and to in is that for it was on with as by from are be at or an".split()
    text = lambda seed, n: " ".join(words[(seed * i * i + 7 * i + seed) % 20] + ("" if i % 3 else f"{seed}x{i}") for i in range(n))
    long = text(3, 40_000)
    assert len(long) > 100_000
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, long, "en", "a"), (3, long, "en", "a"), (4, long + " end", "en", "b"), (None, text(5, 300), "en", None)]
    rows += [(10 + i, text(6 + i // 2, 200), "en", "ab"[i % 2]) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([(*r, 1) for r in rows], schema)
    for c in CLASH:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for at in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, at = at, table(stage(spark, at, SF))
            assert at.columns == docs.columns, name
            assert at.subtract(before).count() == 0, name  # every row is one of the input's, in all columns
            if name == "near dedup":
                assert sorted(r["doc_id"] or 0 for r in at.collect()) == ([0, 3, 10, 12, 14, 16] if before.count() else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in at.collect()}


def test_run_against_brute_force(spark):
    """All stages: quality rules by their SQL twin, the others by plain loops over the texts that are left."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    texts = dict(c.execute("SELECT doc_id, text FROM documents").fetchall())
    source = dict(c.execute("SELECT doc_id, source FROM documents").fetchall())
    names = [d[0] for d in c.execute(oracle_sql()["op10_quality_rules"]).description]
    good = {r[names.index("doc_id")] for r in c.execute(oracle_sql()["op10_quality_rules"]).fetchall() if r[names.index("kept")]}
    groups = {}
    for i in good:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i] or ""), []).append((-len(texts[i] or ""), i))
    exact = {min(g)[1] for g in groups.values()}
    near = kept_by_brute_force({i: texts[i] for i in exact}, 80)
    taken, _ = mixed_by_brute_force([(i, texts[i], source[i]) for i in near], 1024)
    copies = Counter({x[2]: int(n / x[1] + 0.5) for x, n in taken.items()})
    lib, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, n in copies.items():
        ids = np.array([*lib.encode(texts[i], add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(places) <= 1.05 * sum(r["length"] for r in rows) / 2048 + 2
