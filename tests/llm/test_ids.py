"""Ids of other types than long, in every operator: the same results under the ids' own type."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from basketry.llm import best_fit_packing, chat_format, conversation_repair, exact_dedup, mixing, near_dedup, ordinal_quality, periodic_runs, pii, quality_rules, suffix_dedup, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
BASE = "the of and to in is that for it was on with as by from are be at or an"
TEXTS = [None, "", "Mr John Smith wrote " + BASE, "Mr John Smith wrote  " + BASE, BASE + " x" * 9, *(f"{BASE} number {i} ends it, {BASE[i:]}." * 3 for i in range(8))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(100 + i, t, "en", "ab"[i % 2]) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")


def graded(d):
    ratings = d.filter("text is not null").select("doc_id", (F.length("text") % 3).alias("grade"))
    return ordinal_quality.score(d, ordinal_quality.train(d, ratings, 3, bits=10), 2).select("doc_id", F.round("expected_grade", 5))


OPERATORS = {
    "exact": lambda d: exact_dedup.exact_dedup(d, digest=True),
    "pii": lambda d: pii.pseudonymise(d).drop("lang", "source"),
    "mix": lambda d: mixing.mix(mixing.sized(d), block=16)["documents"].drop("source", "place"),
    "near": lambda d: near_dedup.near_dedup(d).drop("_n_tie"),
    "tokens": lambda d: token_counts.token_counts(d, PATH, limit=16),
    "suffix": lambda d: suffix_dedup.suffix_dedup(d, length=50).select("doc_id", "n_removed", "kept"),
    "grades": graded,
    "pack": lambda d: best_fit_packing.pack_documents(d, PATH, 64).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "quality": lambda d: quality_rules.judged(d, keep_text=False).select("doc_id", "n_words", "kept"),
    "runs": periodic_runs.periodic_runs,
}


def ids_as_text(rows):
    return Counter(repr(tuple(str(v) if isinstance(v, int) and v >= 100 else v for v in r)) for r in rows)


@pytest.mark.parametrize("name, kind", [*((n, "string") for n in sorted(OPERATORS)), ("exact", "int"), ("grades", "int"), ("pack", "int"), ("tokens", "int")])
def test_documents(docs, name, kind):
    want, got = OPERATORS[name](docs), OPERATORS[name](docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
    assert dict(got.dtypes)["doc_id"] == kind
    assert ids_as_text(got.collect()) == ids_as_text(want.collect())


@pytest.mark.parametrize("kind", ["int", "string"])
def test_conversations(spark, kind):
    rows = spark.createDataFrame([(100 + c, t, r, x) for c in range(4) for t, (r, x) in enumerate([("user", "Hm?"), ("assistant", "Yes"), ("user", "Hm?")])], "conv_id long, turn long, role string, text string")
    for f in (lambda d: chat_format.chat_format(d).select("conv_id", "formatted"), lambda d: conversation_repair.repair(d)[0]):
        got = f(rows.withColumn("conv_id", F.col("conv_id").cast(kind)))
        assert dict(got.dtypes)["conv_id"] == kind and ids_as_text(got.collect()) == ids_as_text(f(rows).collect())
