"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

In every stage a null text is an empty one. Quality rules drop texts of fewer than ten words, empty ones too. The dedup stages keep the
first of equal rows, so ties and repeated rows end as one row; null ids rank last. The mix counts a null source as a source of its own. Very long texts are
whole in all stages and are only cut into pieces by packing. An empty table passes through all stages. Extra columns, whatever their names,
are carried unchanged up to packing, which returns columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.best_fit_packing import pack_documents
from basketry.llm.common import table
from basketry.llm.exact_dedup import drop_exact_duplicates
from basketry.llm.mixing import resample
from basketry.llm.near_dedup import drop_near_duplicates
from basketry.llm.quality_rules import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a similarity of 0.8 or more on shingles of five words."""
    return drop_near_duplicates(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept once or left out as the slots of the mix deal their blocks."""
    return resample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where each document's tokens lie in the packed sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: Near dedup's signatures, the mix's hash order and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
