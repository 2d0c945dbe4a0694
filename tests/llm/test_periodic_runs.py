"""Periodic runs against brute force, and on null, empty, long, tied and repeated rows."""

import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import periodic_runs as pr
from basketry.llm import queries


def brute(w):
    """Every lag, word by word; a stretch counts for its smallest period only."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            s = w[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(all(s[k] == s[k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_row(doc_id, text):
    """The query's row for one document, planted tail included."""
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 8)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_runs_of_any_words(parts):
    w = [x for part, k in parts for x in part * k]
    assert pr.runs_of(w) == brute(w)


def test_splitting_keeps_every_run_and_is_stable():
    rng = random.Random(5)
    for _ in range(200):
        w = [rng.randrange(12) for _ in range(rng.randrange(80))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = [20, 21, 22] * rng.randrange(3, 7)
        kept = pr.surviving(w, 4, 6)
        for lo, hi in kept:
            assert all(w[lo:hi].count(x) >= 4 for x in w[lo:hi]) and hi - lo >= 6
        assert all(any(lo <= s and s + n <= hi for lo, hi in kept) for s, n, _ in brute(w))


def test_time_does_not_grow_with_the_square():
    rng = random.Random(2)
    for w in (["a"] * 400_000, ["a", "b", "c"] * 130_000, [rng.choice("ab") for _ in range(100_000)], [f"{i // 5 % 997}" for i in range(200_000)]):
        began = time.time()
        pr.runs_of(w)
        assert time.time() - began < 20


ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two three four five six"),
    (5, "ha " * 5),
    (6, "ha " * 6 + "x" + " ho hum" * 4),
    (6, "ha " * 6 + "x" + " ho hum" * 4),
    (None, "é ü " * 9),
    (8, "a\xa0b " * 7 + "c"),
    (9, "la " * 6 + "lo " * 6 + " ".join("uv" * 9)),
    (10, "word " * 3000),
    *[(i, " ".join("abc"[i * k * k % 3] for k in range(50))) for i in range(11, 60)],
]


def test_query_by_brute_force(spark, tmp_path):
    schema = "doc_id long, text string, lang string, runs string, collapsed string, h string"
    docs = spark.createDataFrame([(*r, "en", "r", "c", "h") for r in ROWS], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute_row(*r) for r in ROWS), key=repr)
    made = pr.collapse(docs)
    assert made.columns == docs.columns and made.count() == len(ROWS)
    texts = {r["doc_id"]: r for r in made.collect()}
    assert texts[1]["text"] is None and texts[4]["text"] == ROWS[3][1] and texts[6]["text"] == "ha x ho hum" and texts[10]["runs"] == "r"
    none = spark.createDataFrame([], schema)
    assert pr.collapse(none).count() == 0 and pr.periodic_runs(none).count() == 0


def test_fewer_copies_are_refused():
    with pytest.raises(ValueError):
        pr.runs_of([1] * 9, exponent=2)
