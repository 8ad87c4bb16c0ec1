"""Operator 5: chat formatting, relational, with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one
block, whose texts are parts. A formatted conversation is::

    <|turn|>role<|body|>text<|part|>text<|end|>\\n   for each block

The control strings cannot occur in a text: each of ``CONTROLS`` in a text or role is broken up by a
backslash after its first character, and a backslash is doubled. ``unescape`` undoes just that.
``loss_runs`` is the loss mask in run lengths: pairs (length in code points, counts) over the formatted
text, three for each turn (before, body, after); it counts the escaped texts of the assistant and nothing else.

Edge cases: null texts and roles are empty ones; turns are sorted by turn (null first), role, text, so
ties and repeated rows have one order. Conversations with a null id form one conversation. A
conversation is one output value and thus has to fit into a row; everything else is linear in its size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>"
CONTROLS = (TURN, BODY, PART, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = "(?:" + "|".join(f"(?<=\\Q{c[0]}\\E)(?=\\Q{c[1:]}\\E)" for c in CONTROLS) + ")"
LOSS_ROLE = "assistant"


def escape(col: Column) -> Column:
    """Double each backslash and break up each control string."""
    return F.regexp_replace(F.regexp_replace(col, r"\\", r"\\\\"), _CONTROL, r"\\")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"\\(\\?)", "$1")


def format_conversations(rows: DataFrame) -> DataFrame:
    """rows: (conv_id, turn, role, text). Returns (conv_id, formatted, loss_runs)."""
    turns = rows.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    all_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ts = F.col("ts")

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get(ts, i - 1).role != t.role)
        last = (i == F.size(ts) - 1) | (F.get(ts, i + 1).role != t.role)
        return F.struct(
            F.when(first, F.concat(F.lit(TURN), escape(t.role), F.lit(BODY))).otherwise(F.lit(PART)).alias("before"),
            escape(t.text).alias("body"),
            F.when(last, F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
            (t.role == LOSS_ROLE).alias("loss"),
        )

    pieces = all_turns.withColumn("ps", F.transform(ts, piece))
    runs = F.flatten(F.transform("ps", lambda p: F.array(
        F.struct(F.length(p.before).alias("length"), F.lit(False).alias("counts")),
        F.struct(F.length(p.body).alias("length"), p.loss.alias("counts")),
        F.struct(F.length(p.after).alias("length"), F.lit(False).alias("counts")),
    )))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p.before, p.body, p.after)), "").alias("formatted"),
        runs.alias("loss_runs"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), parts of a block as single turns."""
    q = lambda s: "\\Q" + s + "\\E"
    blocks = F.slice(F.split(formatted, q(TURN)), 2, F.lit(1 << 30))
    turns = F.transform(blocks, lambda b: F.transform(
        F.split(F.regexp_replace(F.substring_index(b, BODY, -1), q(END) + "\\n\\z", ""), q(PART)),
        lambda x: F.struct(unescape(F.substring_index(b, BODY, 1)).alias("role"), unescape(x).alias("text")),
    ))
    return F.flatten(turns)


def under_mask(formatted: Column, runs: Column) -> Column:
    """The pieces of the formatted text that the mask counts, unescaped, in order.

    Control strings never occur in a text, so the formatted text falls apart at each TURN and PART into as many
    pieces as there are triples of runs; each is cut by its own three lengths, in time linear in the whole.
    """
    q = lambda s: "\\Q" + s + "\\E"
    pieces = F.split(formatted, f"(?={q(TURN)}|{q(PART)})")

    def cut(piece: Column, i: Column) -> Column:
        before, body = F.get(runs, 3 * i), F.get(runs, 3 * i + 1)
        return F.when(body.counts, unescape(F.substring(piece, before.length + 1, body.length)))

    return F.filter(F.transform(pieces, cut), lambda x: x.isNotNull())


def control_pattern() -> re.Pattern:
    return re.compile("|".join(map(re.escape, CONTROLS)))
