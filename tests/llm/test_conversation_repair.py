"""Conversation repair against a search over all edits, across blocks, and on null, blank, long, tied and repeated rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm import conversation_repair as cr
from basketry.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, block string, place string, k string, code string"


def cheapest(rows):
    """(cost, audit, lines) by a best-first search on (cost, audit): rows are (role, text, fault)."""
    legal = re.compile(r"(s?(ua)+)?")
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and legal.fullmatch(roles):
            return cost, audit, list(lines)
        if (i, roles[-1:]) in seen or not any(legal.fullmatch(roles + x) for x in ("", "a", "ua")):
            continue
        seen.add((i, roles[-1:]))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + name[0], (*lines, name + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, roles + name[0], (*lines, f"{name}:{text}")))


def expected(rows, damaged=True):
    """The query's rows, conversation by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        mine = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        say = lambda x: " " if x is None else str(x)
        c = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20 if damaged else 9
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        mine += [(turn, "user" if c == 4 else role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    out = []
    for conv, mine in convs.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, judged, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                count[fault] += 1
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit, lines = cheapest(judged)
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(rng, n_convs, most):
    texts = ["Yes.", "No", "Why?", " ", "", None, "a b c", "Well!\n", "é ü.", "ok. ", "no\xa0"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]
    for c in range(n_convs):
        for t in range(rng.randrange(1, most)):
            yield (None if c == 3 else c, rng.choice([t, t, t, t + 2, None if c % 5 == 0 else t]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {c} {t}{rng.choice('.!?x')}")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "p", "k", "c") for r in rows], SCHEMA)


def test_query_by_search(spark, tmp_path):
    rows = list(made(random.Random(3), 60, 9))
    rows += [(100, 0, "user", "w" * 200_000 + "."), (100, 1, "assistant", "Fine."), (101, 5, "user", " \n"), (102, None, "user", "Q?"), (102, None, "user", "Q?")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def by_hand(conversations, least):
    summary, turns = cr.repair(conversations, least)
    costs = {r["conv_id"]: r for r in summary.collect()}
    audits, lines = defaultdict(str), defaultdict(list)
    for r in turns.orderBy("block", "place").collect():
        audits[r["conv_id"]] += "I" * len(r["inserted"]) + (r["edit"] or "") + "D" * max(r["copies"] - 1, 0)
        lines[r["conv_id"]] += [f"{x}:" for x in r["inserted"]] + ([] if r["role"] is None else [f"{r['role']}:{r['text']}"])
    return sorted(((c, r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], audits[c], hashlib.sha256("\n".join(lines[c]).encode()).hexdigest()) for c, r in costs.items()), key=repr)


@pytest.mark.parametrize("least", [1, 4])
def test_blocks_of_the_square_root(spark, least):
    rows = list(made(random.Random(least), 12, 40))
    rows += [(50, 1, "user", "same.")] * 30 + [(50, 0, "assistant", "first?"), (50, 2, "tool", "end")]
    assert by_hand(frame(spark, rows), least) == expected(rows, damaged=False)


def plain(codes):
    """The cost and the ASCII-least edits, with all vectors kept."""
    costs = [cr.END]
    for c in reversed(codes):
        costs.append(cr._before(c, costs[-1]))
    return costs[-1][0], cr.walk(codes, cr.END, 0, True)[1]


def test_one_long_conversation_is_spread_over_tasks(spark):
    n = 40_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.rand(3) < 0.4, "user").when(F.rand(4) < 0.8, "assistant").otherwise("system").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.when(F.rand(5) < 0.3, "").otherwise(".")).alias("text"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    summary, turns = cr.repair(rows)
    blocks = turns.groupBy("block").count().collect()
    assert len(blocks) == 200 and max(r["count"] for r in blocks) <= 201
    audit = "".join("I" * len(r["inserted"]) + (r["edit"] or "") for r in turns.orderBy("block", "place").collect())
    codes = "".join(r["role"][0].upper() if not r["text"].endswith(".") else r["role"][0] for r in rows.orderBy("turn").collect())
    assert (summary.collect()[0]["cost"], audit) == plain(codes)


def test_empty_table(spark):
    summary, turns = cr.repair(spark.createDataFrame([], SCHEMA))
    assert summary.count() == 0 and turns.count() == 0
