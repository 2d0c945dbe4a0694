"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after every white-space character is deleted. One scan writes a narrow profile of every
row: the length and the hash of a prefix. Rows are grouped by length first; the prefix hash is counted only where a length repeats, and
the full text is hashed only where length and prefix repeat. The classes that survive a level become a bitmap of
fixed size, which is broadcast, so all other rows are known to be alone and take part in no shuffle.

Nulls: a null text is an empty text, and empty texts equal each other. A null ``doc_id`` ranks after any number;
a group whose ids are all null has a null ``keep_id``. Rows that repeat both id and text are one document: their
flags are the same, and :func:`drop_exact_duplicates` returns one of them. An empty table gives an empty result.
Other columns never matter, whatever their names: a row travels as one struct beside the helpers' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, packed, squeezed, table, text_of, with_flag

PREFIX_CHARS = 64
_KEY = ["size", "prefix"]


def _refined(docs: DataFrame, key: str, text: str, digest: bool) -> DataFrame:
    """row, id, chars, the first two refinement levels, ``open`` (may have a duplicate) and ``full`` (hash of the full text where open, or of every row)."""
    rows = packed(docs, id=F.col(key), norm=squeezed(text_of(text)), chars=F.length(text_of(text)))
    rows = rows.withColumns({"size": F.octet_length("norm"), "prefix": F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))})
    profile = table(rows.select(*_KEY))
    lengths = profile.groupBy("size").count().filter("count > 1")
    repeated = with_flag(profile, key_bitmap(lengths, ["size"]), ["size"], "again").filter("again").groupBy(*_KEY).count().filter("count > 1")
    open_rows = with_flag(rows, key_bitmap(repeated, _KEY), _KEY, "open")
    full = F.sha2(F.col("norm"), 256)
    return open_rows.withColumn("full", full if digest else F.when(F.col("open"), full))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, and text_sha256 if ``digest``.

    The row with the longest original text stays, then the smallest key. Groups are aggregated with partial sums
    and joined back on the hash, so a group of a third of all rows is never held by one task: the join reads two
    written tables and adaptive execution may split its side of rows.
    """
    rows = table(_refined(docs, key, text, digest).select("id", "chars", *_KEY, "open", F.unhex("full").alias("full")))
    by = [*_KEY, "full"]
    groups = table(
        rows.filter("open")
        .groupBy(*by)
        .agg(F.min(F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id").alias("id"))).alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select(*by, F.col("first.id").alias("keep"), (-F.col("first.col1")).alias("most"), "copies")
    )
    alone = F.col("copies").isNull()
    out = rows.join(groups, by, "left").select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("id").eqNullSafe(F.col("keep")) & (F.col("chars") == F.col("most")))).alias("kept"),
        F.lower(F.hex("full")).alias("text_sha256"),
    )
    return out if digest else out.drop("text_sha256")


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, and one row only of rows that repeat their key too.

    Rows that are surely alone pass through without a shuffle; the others meet in one aggregation that carries the
    row itself and combines on the map side first.
    """
    rows = _refined(docs, key, text, digest=False)
    alone = rows.filter("not open").select("row.*")
    order = F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"), F.xxhash64("row"))
    first = rows.filter("open").groupBy(*_KEY, "full").agg(F.min_by("row", order).alias("row"))
    return alone.unionByName(first.select("row.*"))
