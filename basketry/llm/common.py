"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, table  # noqa: F401

#: The white space that separates words, everywhere in this package.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, SPACE + "+", "")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once (a column bound as a lambda variable)."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


# ---- a set of keys as a bitmap of fixed size -------------------------------------------------------


def slot_of(cols: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits).cast("long"))


def key_bitmap(keys: DataFrame, cols: list[str], bits: int = 22) -> DataFrame:
    """The keys' hash slots as at most ``2**bits / 64`` rows (word, mask), however many keys there are."""
    slots = keys.select(slot_of([F.col(c) for c in cols], bits).alias("slot"))
    return slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("mask"))


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many ``_`` in front as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` of ``docs``, and its whole row as the struct ``row``: so no column of the user meets a helper's name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def with_flag(df: DataFrame, bitmap: DataFrame, cols: list[str], flag: str, bits: int = 22) -> DataFrame:
    """Adds ``flag``: false only if the row's key is surely absent from the bitmap.

    The bitmap is broadcast: its size is bounded by ``bits`` alone. False hits only cost work later. The helper columns
    get names that ``df`` does not have.
    """
    word, mask, slot, at = (fresh(df, f"_{n}") for n in ("word", "mask", "slot", "at"))
    small = F.broadcast(bitmap.select(F.col("word").alias(word), F.col("mask").alias(mask)))
    keyed = df.withColumn(slot, slot_of([F.col(c) for c in cols], bits)).withColumn(at, F.expr(f"{slot} div 64"))
    hit = F.expr(f"coalesce(shiftright({mask}, cast({slot} % 64 as int)) & 1L, 0L) = 1L")
    return keyed.join(small, F.col(at) == F.col(word), "left").withColumn(flag, hit).drop(slot, at, word, mask)
