r"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one
role are merged into a block with array functions, and blocks are concatenated::

    <turn role="user">\n FIRST TEXT <part/> SECOND TEXT </turn>\n

Control strings inside roles and texts are escaped reversibly: a backslash
becomes ``\s``, the ``<`` of ``<turn``, ``</turn`` and ``<part/`` becomes
``\l``, and a quote in a role ``\q``. An escaped text never contains a control
string, and two replacements undo it.

Defined results: a null text or role is empty; ties in ``turn`` are ordered by
role, then text, nulls first; a repeated row is one more turn; an empty table
gives no rows; extra columns are ignored; a null conversation id is a
conversation of its own. A conversation is one output row, so its turns meet in
one task by nature of the result; they are combined map-side before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, PART, CLOSE = '<turn role="', '">\n', "<part/>", "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for mark in ("<turn", "</turn", "<part/"):
        out = F.replace(out, F.lit(mark), F.lit("\\l" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit('"'), F.lit("\\q"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\q"), F.lit('"')))


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    ``segments`` are the pieces of ``formatted`` in order, each with its loss
    flag: exactly the (escaped) texts of ``loss_role`` carry loss, marks never.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = (
        rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    starts = F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> turns[i - 1].role)")
    blocks = F.expr(
        "transform(starts, (s, k) -> struct(turns[s].role AS role,"
        " transform(slice(turns, s + 1, coalesce(get(starts, k + 1), size(turns)) - s), t -> t.text) AS texts))"
    )
    loss = lambda b: b["role"] == F.lit(loss_role)
    segment = lambda s, flag: F.struct(s.alias("text"), flag.alias("loss"))
    no = F.lit(False)

    def render(b: Column) -> Column:
        head = segment(F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit(ROLE_END)), no)
        body = F.flatten(
            F.transform(
                b["texts"],
                lambda t, i: F.when(i == 0, F.array(segment(escape(t), loss(b)))).otherwise(
                    F.array(segment(F.lit(PART), no), segment(escape(t), loss(b)))
                ),
            )
        )
        return F.concat(F.array(head), body, F.array(segment(F.lit(CLOSE), no)))

    return (
        turns.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .select("conv_id", F.flatten(F.transform("blocks", render)).alias("segments"))
        .select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    blocks = F.split(formatted, CLOSE, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substring(b, len(OPEN) + 1, F.length(b)), ROLE_END, 1)
        body = F.substring(b, F.length(role) + len(OPEN) + len(ROLE_END) + 1, F.length(b))
        return F.transform(
            F.split(body, PART, -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
