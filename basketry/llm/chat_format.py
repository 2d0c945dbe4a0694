"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

A template lists, for each role, the segments of a turn: literals and ``{role}`` / ``{text}`` slots, each with a loss
flag. Texts are escaped so that no control string can occur inside them, and the output can be read back exactly.

Rows become turns by (turn, role, text). Nulls: a null text or role is empty, a null ``conv_id`` is a conversation of its
own, a null turn comes first. Rows that repeat a turn are all kept, in the order above. A role that the template does
not name gets the ``*`` segments. Turn order is judged, not enforced: ``valid`` says whether the machine accepts
the roles, and ``bad_turn`` is the first turn (from 0) that it rejects. An empty table gives an empty result. Extra columns are ignored.

Segments are made per row before the shuffle; only the joining of a conversation's own segments into its one output
row meets in one group, as that row must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: role -> segments (pattern, counts towards the loss). ``*`` holds for every other role.
CHATML = {
    "assistant": [(OPEN + "{role}\n", False), ("{text}", True), (CLOSE + "\n", False)],
    "*": [(OPEN + "{role}\n", False), ("{text}", False), (CLOSE + "\n", False)],
}

#: (state, role) -> next state. States name the last speaker; conversations may end after an assistant only.
TURN_ORDER = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
FINAL = ("assistant",)


def escape(text: Column) -> Column:
    """Breaks every ``<|`` by a backslash; a ``<``, backslashes and ``|`` get one backslash more, so it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    line = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(line, F.lit("\\\\"), F.lit("\\")))


def segments_of(role: Column, text: Column, template: dict = CHATML) -> Column:
    """array<struct<text, loss>> of one turn."""

    def filled(parts) -> Column:
        out = []
        for pattern, loss in parts:
            pieces = F.split(F.lit(pattern), r"(?=\{role\}|\{text\})|(?<=\{role\})|(?<=\{text\})")
            value = F.transform(
                pieces, lambda p: F.when(p == "{role}", _escape_role(role)).when(p == "{text}", escape(text)).otherwise(p)
            )
            literal = "{" not in pattern
            whole = F.lit(pattern) if literal else escape(text) if pattern == "{text}" else F.array_join(value, "")
            out.append(F.struct(whole.alias("text"), F.lit(loss).alias("loss")))
        return F.array(*out)

    chosen = filled(template["*"])
    for name, parts in template.items():
        if name != "*":
            chosen = F.when(role == name, filled(parts)).otherwise(chosen)
    return chosen


def _machine(roles: Column, order: dict, final: tuple[str, ...]) -> Column:
    """struct<state, n, bad>: the machine's state after all roles; bad is the first rejected turn."""
    step = F.create_map(*[F.lit(x) for (state, role), to in order.items() for x in (f"{state}>{role}", to)])
    none = F.lit(None).cast("long")
    start = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("n"), none.alias("bad"))

    def move(acc: Column, role: Column) -> Column:
        to = step[F.concat(acc["state"], F.lit(">"), role)]
        bad = F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"]))
        return F.struct(F.coalesce(to, role).alias("state"), (acc["n"] + 1).alias("n"), bad.alias("bad"))

    return F.aggregate(roles, start, move)


def chat_format(conversations: DataFrame, template: dict = CHATML, order: dict = TURN_ORDER, final: tuple[str, ...] = FINAL) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, valid, bad_turn."""
    role, text = text_of("role"), text_of("text")
    turns = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), segments_of(role, text, template).alias("parts")).alias("t"))
    # the sort key is (turn, role, text); the parts after it follow from them
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    parts = F.flatten(F.transform("turns", lambda t: t["parts"]))
    out = convs.select("conv_id", parts.alias("segments"), _machine(roles, order, final).alias("end"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("end.bad").isNull() & F.col("end.state").isin(*final)).alias("valid"),
        F.col("end.bad").alias("bad_turn"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a conversation formatted by :data:`CHATML`."""
    turns = F.split(formatted, r"<\|im_start\|>")
    body = F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        size = F.length(x) - F.length(head) - 1 - len(CLOSE) - 1
        return F.struct(
            _unescape_role(head).alias("role"), unescape(F.substring(x, F.length(head) + 2, size)).alias("text")
        )

    return F.transform(body, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
