"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

* Targets: a water level. Each source asks for ``level * weight`` words and gets at most ``cap`` times its size.
* Every source is a stream: its documents in hash order, cut into blocks of ``block`` words (the last is shorter). A target
  needs so many blocks: whole passes of the stream, then a prefix of it, whose last block is trimmed.
* The schedule has ``2**k`` slots, the least power that holds all needed blocks. The sources' needs, one behind the other, are
  their shares of the grid of ``2**k`` points. Slot ``i`` belongs to the source whose share holds the van der Corput point of
  ``i``; points behind the last share deal nothing. A full period of the sequence meets every point once, so every source gets just the
  slots that it needs, and any prefix of the schedule is close to the targets.
* A slot's rank is how many earlier slots its source had. It follows from the bits of ``i`` and of the share's bounds, so slots are
  ranked without a window. The slot of rank ``r`` takes block ``r`` modulo the source's blocks: a block is taken when, and
  only when, a slot deals it.

Nulls: a null text has size 0, a null source is one source and comes last. Rows of size 0 are in no block and take 0.
An empty table gives an empty result. Repeated rows are separate documents. The order of a stream is fixed by the
seed, the id and the text (MD5), so reruns agree. Extra columns may have any name. Sources are a list of one narrow row each, which a
window puts in order: they may be many thousands, not as many as documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, table, text_of

CELL_BITS = 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size) -> adds rank, weight and target.

    One row per source. The sources of ``sizes`` in code-point order, null last, weigh ``weights`` in turn. The total
    is ``share`` of all sizes. Whoever would exceed ``cap * source_size`` gets just that; the rest is shared again.
    In order of cap per weight, the capped sources are a prefix, so one running sum finds the level.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    by = Window.orderBy((F.col("limit") / F.col("weight")), "rank")
    everything = Window.partitionBy()
    sums = limit.withColumns(
        {
            "total": F.sum("source_size").over(everything) * share[0],
            "before": F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
            "open": F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("before") * share[1]).cast("double") / share[1] / F.col("open")
    first = sums.withColumn("level", level).withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    settled = first.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("level") * F.col("weight"), F.col("limit").cast("double"))
    return settled.select("source", "source_size", F.col("rank").cast("int"), "weight", F.coalesce(target, F.col("limit").cast("double")).alias("target"))


def _shifted(how: str, x: Column, by: Column) -> Column:
    return F.call_function(how, x, by.cast("int"))


def _reversed(x: Column, bits: int) -> Column:
    """The van der Corput point of ``x`` on the grid of ``2**bits`` points: its bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def _intervals(x: Column, bits: int) -> Column:
    """The points [0, x) as dyadic intervals, one per set bit of x, as array<struct<low, step>>.

    Just the slots ``low`` plus a multiple of ``step`` have their point in the interval.
    """

    def part(j: Column) -> Column:
        begin = _shifted("shiftleft", _shifted("shiftright", x, j + 1), j + 1)
        return F.struct(_reversed(begin, bits).alias("low"), _shifted("shiftleft", F.lit(1).cast("long"), F.lit(bits) - j).alias("step"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(bits)), lambda j: F.getbit(x, j) == 1), part)


def _below(n: Column, intervals: Column) -> Column:
    """How many of the first ``n`` slots have their point in the intervals."""
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda acc, p: acc + F.floor((n - p["low"] + p["step"] - 1) / p["step"]).cast("long"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank, pass_no, block_no, words): what the mix reads, in the order of ``slot``.

    ``targets``: source, source_size, target. One row per slot; rows follow the words of the mix, not the documents.
    """
    spark = targets.sparkSession
    live = targets.filter("source_size > 0 and target >= 1").withColumn("words", F.floor("target").cast("long"))
    sized = live.select("source", "source_size", F.expr("words div source_size").alias("full"), F.expr("words % source_size").alias("rest"), F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"))
    needs = table(sized.withColumn("need", F.col("full") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}")))
    total = needs.agg(F.sum("need")).first()[0] or 0  # one number
    bits = max(0, total - 1).bit_length()
    upto = F.sum("need").over(Window.orderBy(F.col("source").asc_nulls_last()))
    shares = needs.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("need"))
    shares = table(shares.withColumns({"at_lo": _intervals(F.col("lo"), bits), "at_hi": _intervals(F.col("hi"), bits)}))
    # a source's share covers cells of the grid: slots and shares meet on the cell by equality
    cell = lambda x: F.shiftright(x, max(0, bits - CELL_BITS))
    cells = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    number = F.col("rank") % F.col("blocks")
    whole = F.least(F.lit(block).cast("long"), F.col("source_size") - number * block)
    trimmed = F.when(F.col("rank") >= F.col("full") * F.col("blocks"), F.least(whole, F.col("rest") - number * block)).otherwise(whole)
    return (
        spark.range(1 << bits if total else 0)
        .withColumn("point", _reversed(F.col("id"), bits))
        .withColumn("cell", cell(F.col("point")))
        .join(cells, "cell")  # at most 2**CELL_BITS rows and one per source
        .filter("point >= lo and point < hi")
        .withColumn("rank", _below(F.col("id"), F.col("at_hi")) - _below(F.col("id"), F.col("at_lo")))
        .select(F.col("id").alias("slot"), "source", "rank", F.expr("rank div blocks").alias("pass_no"), number.alias("block_no"), trimmed.alias("words"))
    )


def _place(seed: int, key: Column, text: Column) -> Column:
    """A row's place in its source's stream: a digest of seed, id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), text_of(text)))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """(doc_id, source, size in words, place): narrow rows, written once."""
    size = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    return table(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _place(seed, F.col(key), F.col(text)).alias("place")))


def _streams(rows: DataFrame) -> DataFrame:
    """Adds ``begin``: the words before the row in its source's stream.

    A two-level prefix sum: sums per (source, first digits of the place) first, so that a source of a third of all rows
    spreads over 4096 windows, and only one row per source and chunk meets in the upper window.
    """
    chunk = rows.withColumn("chunk", F.substring("place", 1, 3))
    upper = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = chunk.groupBy("source", "chunk").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(upper), zero)).alias("b")
    lower = Window.partitionBy("source", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    within = chunk.withColumn("inside", F.coalesce(F.sum("size").over(lower), zero)).alias("w")
    joined = within.join(before, F.expr("w.source <=> b.source and w.chunk = b.chunk"))
    return joined.select(*[f"w.{c}" for c in rows.columns], (F.col("before") + F.col("inside")).alias("begin"))


def mix(rows: DataFrame, block: int = 1024, **how) -> dict[str, DataFrame]:
    """``rows`` of :func:`sized` -> targets, slots (:func:`schedule`), segments and documents.

    segments: where each document lies in its source's blocks (source, block_no, start, length, begin). documents:
    doc_id, source, place, size, source_size, target, taken, first_slot (null if the mix leaves the document out). A document spans several
    blocks and its segments are joined on (source, block_no), at most ``block`` words each, so no key is hot.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = table(source_targets(sizes, **how))
    slots = schedule(targets, block)
    placed = table(_streams(rows.filter("size > 0")))
    spread = placed.withColumn("block_no", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    start = F.greatest(F.col("begin"), F.col("block_no") * block)
    stop = F.least(F.col("begin") + F.col("size"), (F.col("block_no") + 1) * block)
    segments = spread.select("source", "begin", "doc_id", "place", "size", "block_no", (start - F.col("block_no") * block).alias("start"), (stop - start).alias("length"))
    uses = slots.groupBy("source", "block_no", "words").agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("slot"))
    joined = segments.alias("s").join(uses.alias("u"), F.expr("s.source <=> u.source and s.block_no = u.block_no"), "left")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("length"), F.col("words") - F.col("start"))) * F.col("times")
    taken = joined.withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).groupBy("s.source", "begin").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "place", "size")], F.sum("part").alias("taken"), F.min(F.when(F.col("part") > 0, F.col("slot"))).alias("first_slot")
    )
    empty = rows.filter("size = 0").select("source", "doc_id", "place", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    every = taken.drop("begin").unionByName(empty).alias("d")
    t = targets.select("source", "source_size", "target").alias("t")
    documents = every.join(t, F.expr("d.source <=> t.source")).select("d.doc_id", "d.source", "d.place", "d.size", "t.source_size", "t.target", "d.taken", "d.first_slot")
    return {"targets": targets, "slots": slots, "segments": segments, "documents": documents}


def resample(docs: DataFrame, block: int = 1024, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **how) -> DataFrame:
    """``docs`` repeated as the mix's slots take them: ``taken / size`` copies, rounded, of each whole document.

    A document that a trimmed block cuts counts whole or not at all, so a source's words miss its target by at most half of that document. Documents
    without words stay once. Rows that repeat source, id and text get equal numbers of copies. Rows leave in no order of their
    own; ``mix(...)["documents"]`` has the slots.
    """
    found = mix(sized(docs, key, text, source, seed), block, **how)["documents"].filter("size > 0")
    # one row per (source, place); the place holds id and text
    copies = found.groupBy("source", "place").agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("copies")).filter("copies > 0").alias("c")
    words = text_of(text).rlike(WORD)
    rows = packed(docs, source=F.col(source), place=_place(seed, F.col(key), F.col(text)), words=words).alias("d")
    taken = rows.filter("words").join(copies, F.expr("d.source <=> c.source and d.place = c.place"))
    again = taken.withColumn("copy", F.explode(F.expr("sequence(1, c.copies)"))).select("row")
    return again.unionByName(rows.filter("not words").select("row")).select("row.*")
