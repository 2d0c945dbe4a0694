"""Conversation structure repair: faults of each row, and the cheapest edits that make a conversation well formed.

Rows (conv_id, turn, role, text) are read by (turn, then a digest of role and text); nulls come first. A row's first fault counts: blank (a text without a
letter or mark), duplicate (its role and text were seen earlier in the conversation), truncated (its last mark is not one of ``.!?``). Edits: Keep, at no cost; Rerole to user or assistant, 2; Delete, 3, required for blank and
duplicate rows; Insert a turn without text, user or assistant, 2. A truncated row that stays costs 1. Roles are judged by their first letter and have to give
``(s?(ua)+)?``, so the machine has four states, and after any edit the next state is known. Of the cheapest edits those with the ASCII-least initials are taken (D, I, K, R).

A conversation of m rows is cut into blocks of the square root of m rows (``least`` at least). A block's rows compose to a 4 x 4 matrix of costs, so the backward vectors of
costs are stored at the blocks' ends only: one task scans a conversation's matrices, not its rows. Every block then computes the vectors between its own checkpoints again and walks
forward from each state it may be entered in; another scan over blocks picks the walks that join. So no task holds a conversation: it holds a block, or
one small row per block. Places come from a range partitioning, and equal rows (same turn, role and text) are counted before anything is shuffled. Texts take no part before the end.

Nulls: a null role or text is one space; a null ``conv_id`` is a conversation of its own; null turns come first and are no turns for the gaps. Empty texts are
blank; long ones are read whole, where they lie. Ties in turn are broken by the digest; repeated rows are duplicates of each other. An empty
table gives empty results. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import table

SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 60
#: States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.
NEXT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
ROLE = {2: "user", 3: "assistant"}
LEGAL = ("su", "ua", "au")
#: Codes of a row: its initial s, u, a or x (any other), as a capital if it is truncated, as a digit if it has to go.
GONE = dict(zip("0123", "suax", strict=True))


def _closed(c: tuple) -> tuple:
    """Costs when turns may be inserted first."""
    two, three = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + two), min(c[1], INSERT + two), two, three


END = _closed((0, FAR, FAR, 0))


def _before(code: str, after: tuple) -> tuple:
    """The costs by state before a row, from those after it."""
    if code in GONE:
        return _closed(tuple(DELETE + c for c in after))
    keep, extra = KEEP[code.lower()], TRUNCATED * code.isupper()
    return _closed(tuple(min(DELETE + after[s], REROLE + extra + after[NEXT[s]], FAR if keep[s] is None else extra + after[keep[s]]) for s in range(4)))


@lru_cache(1024)
def block_matrix(codes: str) -> list[int]:
    """The least costs from each state before the block to each state after its last row, row by row of the matrix."""
    columns = []
    for end in range(4):
        costs = tuple(0 if s == end else FAR for s in range(4))
        for code in reversed(codes):
            costs = _before(code, costs)
        columns.append(costs)
    return [min(columns[t][s], FAR) for s in range(4) for t in range(4)]


def checkpoints(matrices: list[list[int]]) -> tuple[list[list[int]], int]:
    """The cost vectors at the ends of the blocks, from the last to the first, and the cost of all."""
    costs, ends = list(END), []
    for m in reversed(matrices):
        ends.append(costs)
        costs = [min(m[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
    return ends[::-1], costs[0]


@lru_cache(1024)
def walk(codes: str, end: tuple, state: int, last: bool) -> tuple[int, str]:
    """The state after a block and the initials of its ASCII-least edits, when it is entered in ``state`` and the costs at its end are ``end``."""
    costs = [end]
    for code in reversed(codes):
        costs.append(_before(code, costs[-1]))
    costs.reverse()
    edits = []
    for code, here, after in zip(codes, costs, costs[1:], strict=False):
        keep, extra = KEEP[GONE.get(code, code.lower())], TRUNCATED * code.isupper()
        while True:
            if DELETE + after[state] == here[state]:
                edits.append("D")
                break
            if INSERT + here[NEXT[state]] == here[state]:
                edits.append("I")
                state = NEXT[state]
                continue
            kept = keep[state] is not None and extra + after[keep[state]] == here[state]
            edits.append("K" if kept else "R")
            state = keep[state] if kept else NEXT[state]
            break
    while last and state not in (0, 3):
        edits.append("I")
        state = NEXT[state]
    return state, "".join(edits)


def spelled(codes: str, state: int, edits: str) -> list[dict]:
    """Per row of a block: the roles inserted before it, its edit, and its new role if it has one. Insertions at the end are one item more, without an edit."""
    out, roles, rows = [], [], iter(codes)
    for e in edits:
        if e == "I":
            state = NEXT[state]
            roles.append(ROLE[state])
            continue
        code, role = next(rows), None
        if e == "K":
            state = KEEP[code.lower()][state]
        elif e == "R":
            state = NEXT[state]
            role = ROLE[state]
        out.append({"inserted": roles, "edit": e, "role": role})
        roles = []
    return [*out, {"inserted": roles, "edit": None, "role": None}] if roles else out


def _matrix(codes: pa.Array) -> pa.Array:
    def one(c: str) -> dict:
        roles = "".join(GONE.get(x, x.lower()) for x in c)
        return {"matrix": block_matrix(c), "illegal": sum(roles[i : i + 2] not in LEGAL for i in range(len(c) - 1)), "edges": roles[0] + roles[-1]}

    return pa.array(list(map(one, codes.to_pylist())), pa.struct([("matrix", pa.list_(pa.int64())), ("illegal", pa.int64()), ("edges", pa.string())]))


def _checkpoints(blocks: pa.Array) -> pa.Array:
    def one(parts: list[dict]) -> dict:
        ends, cost = checkpoints([p["matrix"] for p in parts])
        between = sum(a["edges"][1] + b["edges"][0] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
        return {"ends": ends, "cost": cost, "illegal": between + sum(p["illegal"] for p in parts)}

    return pa.array(list(map(one, blocks.to_pylist())), pa.struct([("ends", pa.list_(pa.list_(pa.int64()))), ("cost", pa.int64()), ("illegal", pa.int64())]))


def _walks(codes: pa.Array, ends: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    rows = zip(codes.to_pylist(), ends.to_pylist(), first.to_pylist(), last.to_pylist(), strict=True)
    made = [[dict(zip(("state", "edits"), walk(c, tuple(e), s, z), strict=True)) for s in range(1 if a else 4)] for c, e, a, z in rows]
    return pa.array(made, pa.list_(pa.struct([("state", pa.int32()), ("edits", pa.string())])))


def _spelled(codes: pa.Array, state: pa.Array, edits: pa.Array) -> pa.Array:
    rows = zip(codes.to_pylist(), state.to_pylist(), edits.to_pylist(), strict=True)
    return pa.array([spelled(*r) for r in rows], pa.list_(pa.struct([("inserted", pa.list_(pa.string())), ("edit", pa.string()), ("role", pa.string())])))


#: The kernels as columns, and what they return.
KERNELS = {
    _matrix: "matrix array<long>, illegal long, edges string",
    _checkpoints: "ends array<array<long>>, cost long, illegal long",
    _walks: "array<struct<state: int, edits: string>>",
    _spelled: "array<struct<inserted: array<string>, edit: string, role: string>>",
}


def _column(kernel, *args: str | Column) -> Column:
    return F.arrow_udf(kernel, KERNELS[kernel])(*args)


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _rows(conversations: DataFrame) -> DataFrame:
    """k (the conversation), at (turn, digest of role and text), role, text."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(F.struct("conv_id").alias("k"), F.struct("turn", _digest(role, text).alias("h")).alias("at"), role.alias("role"), text.alias("text"))


def judged(conversations: DataFrame) -> DataFrame:
    """Narrow rows k, at, n (equal rows of a turn), blank, duplicate, truncated (counts) and code."""
    end = F.right(F.btrim("text", F.lit(SPACES)), F.lit(1))
    start = F.left("role", F.lit(1))
    marks = _rows(conversations).select("k", "at", F.when(start.isin("s", "u", "a"), start).otherwise("x").alias("initial"), (end == "").alias("void"), (~end.isin(".", "!", "?")).alias("open"))
    seen = table(marks.groupBy("k", "at", "initial", "void", "open").agg(F.count(F.lit(1)).alias("n")))
    again = seen.groupBy("k", F.col("at.h").alias("h")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    both = seen.alias("s").join(again.alias("g"), (F.col("s.k") == F.col("g.k")) & (F.col("s.at.h") == F.col("g.h")), "left").select("s.*", (F.col("first").isNotNull() & (F.col("at") != F.col("first"))).alias("later"))
    kept = ~F.col("void") & ~F.col("later")
    zero = F.lit(0).cast("long")
    code = F.when(~kept, F.translate("initial", "suax", "0123")).when(F.col("open"), F.upper("initial")).otherwise(F.col("initial"))
    return both.select(
        "k",
        "at",
        "n",
        F.when(F.col("void"), F.col("n")).otherwise(zero).alias("blank"),
        F.when(F.col("void"), zero).when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1).alias("duplicate"),
        (kept & F.col("open")).cast("long").alias("truncated"),
        code.alias("code"),
    )


def _placed(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with pos (from 0 in its conversation), block and blocks (how many there are). Equal rows count once."""
    dealt = table(rows.repartitionByRange("k", "at").withColumn("part", F.spark_partition_id()))
    by = Window.partitionBy("k")
    counts = dealt.groupBy("k", "part").agg(F.count(F.lit(1)).alias("c"))  # at most one row per conversation and partition
    offsets = counts.select("k", "part", (F.sum("c").over(by.orderBy("part")) - F.col("c")).alias("offset"), F.sum("c").over(by).alias("m"))
    pos = F.col("offset") + F.row_number().over(Window.partitionBy("k", "part").orderBy("at")) - 1
    width = F.greatest(F.ceil(F.sqrt("m")), F.lit(least))
    out = dealt.join(offsets, ["k", "part"]).withColumns({"pos": pos.cast("long"), "width": width})
    return out.withColumns({"block": F.expr("pos div width"), "blocks": F.expr("(m - 1) div width + 1")}).drop("offset", "m", "part", "width")


def repair(conversations: DataFrame, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(summary, turns) of all conversations.

    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost. turns, one row per input row (equal rows of a turn once): conv_id, block and place
    (their order), inserted (roles inserted before it), edit, copies (rows of it; all but the first are deleted), role and text (null if deleted). Insertions at the end are a row without an edit.
    """
    ship(conversations.sparkSession)
    rows = judged(conversations)
    blocks = _placed(rows, least).groupBy("k", "block", "blocks").agg(
        F.sort_array(F.collect_list(F.struct("pos", "code", "at", "n"))).alias("rows"),
        *[F.sum(c).alias(c) for c in ("n", "blank", "duplicate", "truncated")],
        F.collect_set("at.turn").alias("turns"),
    )
    codes = F.array_join(F.transform("rows", lambda r: r["code"]), "")
    blocks = table(blocks.withColumn("codes", codes).withColumn("m", _column(_matrix, "codes")))
    # one small row per block: what a conversation's scan reads
    scan = blocks.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("block", "m.matrix", "m.illegal", "m.edges"))).alias("b"))
    scan = table(scan.withColumn("s", _column(_checkpoints, "b")).select("k", "s.*"))
    ends = scan.select("k", F.posexplode("ends").alias("at_block", "end")).select("k", F.col("at_block").cast("long").alias("block"), "end")
    walks = table(blocks.select("k", "block", "blocks", "codes").join(ends, ["k", "block"]).select("k", "block", "codes", _column(_walks, "codes", "end", F.col("block") == 0, F.col("block") == F.col("blocks") - 1).alias("walks")))
    states = walks.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("block", F.transform("walks", lambda w: w["state"]).alias("to")))).alias("b"))
    entered = F.expr("slice(aggregate(b, array(0), (s, x) -> array_append(s, x.to[element_at(s, -1)])), 1, size(b))")
    states = states.select("k", F.posexplode(entered).alias("at_block", "state")).select("k", F.col("at_block").cast("long").alias("block"), "state")
    chosen = walks.join(states, ["k", "block"]).select("k", "block", _column(_spelled, "codes", "state", F.expr("walks[state].edits")).alias("ops"))
    ops = chosen.join(blocks.select("k", "block", "rows"), ["k", "block"]).select("k", "block", F.posexplode(F.arrays_zip("rows", "ops")).alias("place", "x"))
    ops = ops.select("k", "block", "place", "x.ops.inserted", "x.ops.edit", F.col("x.ops.role").alias("new_role"), F.col("x.rows.at").alias("at"), F.coalesce("x.rows.n", F.lit(0)).alias("copies"))
    texts = _rows(conversations).groupBy("k", "at").agg(F.first(F.struct("role", "text")).alias("was"))
    stays = F.col("edit").isin("K", "R")
    turns = ops.join(texts, ["k", "at"], "left").select(
        "k.conv_id", "block", "place", "inserted", "edit", "copies", F.when(stays, F.coalesce("new_role", "was.role")).alias("role"), F.when(stays, F.col("was.text")).alias("text")
    )
    return _summary(blocks, scan), turns


def _summary(blocks: DataFrame, scan: DataFrame) -> DataFrame:
    sums = blocks.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "blank", "duplicate", "truncated")], F.sum(F.size("rows")).alias("different"))
    listed = blocks.select("k", F.explode("turns").alias("turn")).groupBy("k", "turn").agg(F.lit(1).alias("one"))  # a turn may lie in two blocks
    spans = listed.groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    out = sums.join(spans, "k", "left").join(scan.select("k", "cost", "illegal"), "k")
    # the copies of a row follow it with its own role, and are deleted
    copies = F.col("n") - F.col("different")
    return out.select("k.conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + copies).alias("illegal"), (F.col("cost") + DELETE * copies).alias("cost"))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults chosen by c = crc32(``conv_id:turn``) % 20, for judging the operator; nulls are one space.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    gap = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", gap("role").alias("role"), gap("text").alias("text"), (F.crc32(F.concat(gap("conv_id"), F.lit(":"), gap("turn")).cast("binary")) % 20).alias("_c")).filter("_c <> 0")
    c = F.col("_c")
    text = F.when(c == 1, F.lit("")).when(c == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(c == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(c == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_i"))
    return rows.drop("_i")
