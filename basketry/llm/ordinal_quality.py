"""A quality classifier: ordinal cumulative-link regression on graded ratings.

A document is the set of its hashed words and a few hashed shape marks (share of symbols, capitals, digits, repeated words, in steps). All grades
share one weight per hash bucket; ordered thresholds cut the score: ``P(grade <= k) = logistic(threshold_k - score)``. The model gives
the expected grade and the tail probability ``P(grade >= keep_grade)`` that selection uses.

Fitting uses at most ``sample`` labelled rows (those with the least hash of their id, a documented bound; an id on several rows counts once, with the
text of the least hash) in one task; scoring covers every row and
whole texts, and ships the weights (``2**bits`` numbers) as one value. Labelled rows are joined by id; the labels are the small side or not, as
Spark finds, and only their documents' features move.

Nulls: a null text has no words and scores by its marks alone; rows with a null rating are not used for fitting; a null id is never labelled. Without any
usable label all weights are 0 and the thresholds even. Repeated rows, empty tables and extra columns are fine.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import text_of
from .shingles import batches, mixed, shingle_sets

_ASCII = "".join(map(chr, range(33, 127)))
WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(c for c in _ASCII if not c.isalpha()).encode(), b"abcdefghijklmnopqrstuvwxyz" + b" " * sum(not c.isalpha() for c in _ASCII))
SYMBOLS = "#*$%&|<>!"
MARK_COPIES = 8


def _marks(text: str, words: int) -> np.ndarray:
    """Shape marks: each share in steps of a factor of two, in several buckets each, as a mark says more than a word."""
    n = max(1, len(text))
    shares = [sum(map(text.count, SYMBOLS)) / n, sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n, sum(map(text.count, "0123456789")) / n, words / max(1, text.count(" ") + 1)]
    steps = [int(np.clip(np.floor(np.log2(x + 1e-4)), -12, 0)) for x in shares]
    return mixed(np.array([copy * 10_000 + (i + 1) * 1000 - s for i, s in enumerate(steps) for copy in range(MARK_COPIES)], dtype=np.uint64))


def features(texts: list[str | None], bits: int) -> list[np.ndarray]:
    """Each text's buckets, distinct."""
    sets = shingle_sets(texts, 1, WORDS)
    out = []
    for t, words in zip(texts, sets, strict=True):
        h = np.concatenate([words, _marks(t or "", len(words))])
        out.append(np.unique((h >> np.uint64(64 - bits)).astype(np.int32)))
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, steps: int = 400, rate: float = 0.1, shrink: float = 3e-5, flat: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, thresholds, moved) by full-batch Adam on the mean log loss. Thresholds are a first one and positive gaps.

    Ends when no weight changed by more than ``flat`` of the largest one in a step, or after ``steps`` steps, which is an early stop: ``moved`` is the last step's largest change
    over the largest weight, so it says whether the fit had settled.
    """
    w = np.zeros(1 << bits)
    cuts = np.concatenate(([-1.0], np.full(n_grades - 2, 0.5)))  # first, log gaps
    if not len(rows):
        return w, _thresholds(cuts), 0.0
    buckets, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(50.0)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)]
    for step in range(1, steps + 1):
        t = np.concatenate(([-np.inf], _thresholds(cuts), [np.inf]))
        s = np.add.reduceat(w[buckets], starts) * scale
        hi, lo = _logistic(t[grades + 1] - s), _logistic(t[grades] - s)
        p = np.maximum(hi - lo, 1e-9)
        ds = (1 - hi - lo) / len(rows)
        gw = np.bincount(buckets, weights=(ds * scale)[owner], minlength=len(w)) + shrink * w
        gt = np.zeros(n_grades + 1)
        np.add.at(gt, grades + 1, -hi * (1 - hi) / p / len(rows))
        np.add.at(gt, grades, lo * (1 - lo) / p / len(rows))
        gt = gt[1:-1]
        gc = np.concatenate(([gt.sum()], [gt[k:].sum() * np.exp(cuts[k]) for k in range(1, n_grades - 1)]))
        before = w.copy()
        for x, g, m, v in ((w, gw, *moments[:2]), (cuts, gc, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        moved = float(np.abs(w - before).max() / max(np.abs(w).max(), 1e-300))
        if moved <= flat:
            break
    return w * scale, _thresholds(cuts), moved


def _thresholds(cuts: np.ndarray) -> np.ndarray:
    return cuts[0] + np.concatenate(([0.0], np.cumsum(np.exp(cuts[1:]))))


def _featured(bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            for at in batches(texts):
                rows = part.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("grade"), rows.column("tie"), pa.array(features(texts[at], bits), pa.list_(pa.int32()))], names=["doc_id", "grade", "tie", "buckets"])

    return run


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = 8192, bits: int = 18, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """``ratings``: key, grade (0 worst). Returns (weights, thresholds). Ids may have any type that can be ordered. Warns if the last step still moved a weight by more than a hundredth of the largest."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    usable = ratings.filter("grade is not null").groupBy(key).agg(F.min("grade").cast("int").alias("grade"))
    # the bounded sample: at most ``sample`` ids, so both the broadcast and the one task are bounded
    chosen = usable.orderBy(F.xxhash64(F.lit(1), key), key).limit(sample)
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(chosen.withColumnRenamed(key, "doc_id")), "doc_id")
    # one row per id, whatever the order of arrival: the text of the least hash
    every = rows.withColumn("tie", F.xxhash64("text")).mapInArrow(_featured(bits), f"doc_id {kind}, grade int, tie long, buckets array<int>")
    data = every.groupBy("doc_id").agg(F.min_by(F.struct("grade", "buckets"), "tie").alias("r")).select("doc_id", "r.*")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([*parts] or [pd.DataFrame({"doc_id": [], "grade": [], "buckets": []})])
        got = got.sort_values("doc_id")
        w, t, moved = fit([*got["buckets"]], got["grade"].to_numpy(dtype=np.int64), n_grades, bits)
        yield pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "t": [t.tolist()], "moved": [moved]})

    one = data.repartition(1).mapInPandas(run, "w binary, t array<double>, moved double").first()
    if one["moved"] > 0.01:
        warnings.warn(f"the fit had not settled: its last step moved a weight by {one['moved']:.2g} of the largest", stacklevel=2)
    return np.frombuffer(one["w"], dtype=np.float32), np.array(one["t"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep_grade: int, tail: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, expected_grade, tail_probability, kept."""
    spark = docs.sparkSession
    ship(spark)
    weights, thresholds = spark.sparkContext.broadcast(model[0]), model[1]
    bits = len(model[0]).bit_length() - 1

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, s = part.tolist(), []
            for at in batches(texts):
                s += [float(weights.value[x].sum()) for x in features(texts[at], bits)]
            above = 1 - _logistic(thresholds[None, :] - np.array(s)[:, None])  # P(grade > k)
            yield pd.DataFrame({"expected_grade": above.sum(axis=1), "tail_probability": above[:, keep_grade - 1]})

    scored = F.pandas_udf(run, "expected_grade double, tail_probability double")
    out = docs.select(F.col(key), scored(text_of(text)).alias("s")).select(key, "s.*")
    return out.withColumn("kept", F.col("tail_probability") >= tail)
