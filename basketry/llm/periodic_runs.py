"""Periodic run detection: stretches of words that repeat with a short period four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least ``max(min_length,
exponent * q)``, as long as it can be. Each of its words occurs ``exponent`` times or more in it. So a word that occurs less often in a segment belongs
to no run there, and splits it; the parts are judged by their own counts until none splits. The counts of the largest part come from those of the whole
less the other parts, so a word is counted again only when its segment has halved. What survives is scanned lag by lag: a run of lag q holds three
neighbouring blocks of the grid of q words, so blocks are compared by prefix hashes (n / q of them for a lag, n log n in all), and what agrees is
extended word by word. A hash never decides: it only chooses where words are compared. Blocks inside a run of a smaller period are that run's own multiples.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and no runs. Documents are independent: repeated rows and null ids get a result each; an empty
table gives an empty one. Columns of the user, whatever their names, are carried by :func:`collapse` and not read. A text is one row of one task;
its time is n log n in its words, also for one word repeated a million times.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def surviving(words: list, least: int, shortest: int) -> list[tuple[int, int]]:
    """The segments [lo, hi) of at least ``shortest`` words in which every word occurs ``least`` times or more, left after recursive splitting."""
    if len(words) < shortest:
        return []
    where = defaultdict(list)
    for i, w in enumerate(words):
        where[w].append(i)
    counts = {w: len(at) for w, at in where.items()}
    out, todo = [], [(0, len(words), counts, list(counts))]
    while todo:
        lo, hi, counts, suspects = todo.pop()
        cuts = []
        for w in suspects:
            if counts[w] < least:
                at = where[w]
                cuts += at[bisect_left(at, lo) : bisect_left(at, hi)]
        if not cuts:
            out.append((lo, hi))
            continue
        cuts.sort()
        parts = [(a, b) for a, b in zip([lo, *(c + 1 for c in cuts)], [*cuts, hi], strict=True) if b - a >= shortest]
        for a, b in parts:
            if 2 * (b - a) <= hi - lo:
                own = Counter(words[a:b])
                todo.append((a, b, own, list(own)))
            else:  # the one part of more than half
                gone = Counter(words[lo:a])
                gone.update(words[b:hi])
                for w, n in gone.items():
                    counts[w] -= n
                todo.append((a, b, counts, [w for w in gone if counts[w] > 0]))
    return out


def _matches(ids: np.ndarray, s: int, q: int) -> tuple[int, int]:
    """The widest [l, r) around ``s`` with ids[i] == ids[i + q] for all its i; l = r = s if there is none."""
    n, r, step = len(ids) - q, s, max(64, q)
    while r < n:
        same = ids[r : min(r + step, n)] == ids[r + q : min(r + step, n) + q]
        stop = int(same.argmin())
        if not same[stop]:
            r += stop
            break
        r, step = r + len(same), 2 * step
    if r == s:
        return s, s
    left, step = s, max(64, q)
    while left > 0:
        a = max(0, left - step)
        same = (ids[a:left] == ids[a + q : left + q])[::-1]
        stop = int(same.argmin())
        if not same[stop]:
            return left - stop, r
        left, step = a, 2 * step
    return left, r


def lag_scan(words: list, exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in ``words``, from the smallest period to the largest."""
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    n = len(ids)
    power = np.cumprod(np.full(n + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    value = np.random.default_rng(1).integers(1, 1 << 63, len(known), dtype=np.uint64)[ids]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * power[:n])])
    reach = np.zeros(n, dtype=np.int64)  # the furthest end of a run found so far that holds the word
    out = []
    for q in range(1, n // exponent + 1):
        first = ids[: n // q * q : q]
        hits = np.flatnonzero((first[:-2] == first[1:-1]) & (first[1:-1] == first[2:])) * q
        if not len(hits):
            continue
        hits = hits[reach[hits] < hits + 2 * q]
        if q > 1 and len(hits):
            block = lambda k: total[hits + (k + 1) * q] - total[hits + k * q]  # noqa: B023, E731
            b1 = block(1)
            hits = hits[(block(0) * power[q - 1] == b1) & (b1 * power[q - 1] == block(2))]
        done = -1
        for s in hits.tolist():
            if s < done or reach[s] >= s + 2 * q:
                continue
            left, done = _matches(ids, s, q)
            length = done - left + q
            if length >= max(shortest, exponent * q):
                out.append((left, length, q))
                np.maximum(reach[left : left + length], left + length, out=reach[left : left + length])
    return out


def runs_of(words: list, exponent: int = 4, min_length: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. A word of a run occurs at least ``exponent`` times in it."""
    if exponent < 4:
        raise ValueError("exponent must be 4 or more: fewer copies don't hold three blocks of the grid")
    shortest = max(min_length, exponent)
    return sorted((lo + s, n, q) for lo, hi in surviving(words, exponent, shortest) for s, n, q in lag_scan(words[lo:hi], exponent, shortest))


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        step[s + q] += 1
        step[s + n] -= 1
    keep = np.cumsum(step[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def run_columns(text: Column, exponent: int = 4, min_length: int = 6) -> Column:
    """struct<runs, collapsed> of a text: its runs by start and period, and its kept words joined by one space."""

    @F.arrow_udf(SCHEMA)
    def found(texts: pa.Array) -> pa.Array:
        runs, left = [], []
        for t in texts:
            words = (t.as_py() or "").encode().split()  # bytes split at exactly the six characters of white space
            mine = runs_of(words, exponent, min_length)
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
            left.append(b" ".join(collapsed_words(words, mine)).decode())
        return pa.StructArray.from_arrays([pa.array(runs, RUNS), pa.array(left, pa.string())], ["runs", "collapsed"])

    return found(text)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = 4, min_length: int = 6) -> DataFrame:
    """One row per document: ``key``, runs and collapsed."""
    ship(docs.sparkSession)
    both = docs.select(F.col(key).alias(key), run_columns(F.col(text), exponent, min_length).alias("_found"))
    return both.select(key, "_found.runs", "_found.collapsed")


def collapse(docs: DataFrame, text: str = "text", exponent: int = 4, min_length: int = 6) -> DataFrame:
    """``docs`` with the repeats of all runs removed from ``text``; texts without a run, and all other columns, are as they were."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), run_columns(F.col(f"`{text}`"), exponent, min_length).alias("found"))
    mended = F.when(F.size("found.runs") > 0, F.col("found.collapsed")).otherwise(F.col("row").getField(text))
    return rows.select(*[(mended if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a periodic tail in every tenth document or so, from the checksum of its id: for judging the operator.

    With h = crc32(id) and g = h div 10: if h % 10 = 0 and the text has n > 0 words, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8). A null id has no checksum.
    """
    from .quality_rules import words_of

    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.crc32(F.col(key).cast("string").cast("binary")).alias("_h"))
    rows = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, words_of(F.col("text")))).withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.expr("if(_n > 0, _g % _n, null)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    made = F.expr("array_join(transform(sequence(0L, _n - 1), i -> get(_w, cast(if(i >= _a, _a + (i - _a) % _p, i) as int))), ' ')")
    return rows.select(key, F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))
