"""Relational chat formatting, in DataFrame expressions only.

The turns of a conversation are collected as structs, sorted by turn (then role,
then text), cut into runs of one role, and concatenated:

    <|turn|>role<|text|>text<|more|>text of the next turn of that role<|end|>

Every marker starts with ``<|``. Inside roles and texts a backslash goes between
``<`` and ``|`` (one more where there are some already), so no text can hold a
marker and removing one backslash gives the text back.

``segments`` cuts the output into pieces that lie under the loss mask (a text of
``loss_role``) or not; ``formatted`` is their concatenation.

No rows give no rows. A null text or role counts as empty, a null turn sorts
first, a null conv_id is a conversation of its own. Equal rows stay repeated.
Other columns are ignored. One conversation is one output value, so its turns
have to fit into a task's memory; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _literal(marker: str) -> str:
    return r"\Q" + marker + r"\E"


def _joined(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def _runs(turns: Column) -> Column:
    """Adjacent turns of one role as ``role, texts``."""
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (turns[i]["role"] != F.get(turns, i - 1)["role"]))
    return F.transform(starts, lambda first, k: F.struct(
        turns[first]["role"].alias("role"),
        F.transform(
            F.slice(turns, first + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - first), lambda t: t["text"]
        ).alias("texts"),
    ))


def _segments(messages: Column, loss_role: str) -> Column:
    def message(m: Column) -> Column:
        learn = m["role"] == loss_role
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(TURN), escaped(m["role"]), F.lit(TEXT))
        bodies = F.flatten(F.transform(m["texts"], lambda t, i: F.array(
            piece(F.when(i > 0, F.lit(MORE)).otherwise(F.lit("")), F.lit(False)), piece(escaped(t), learn),
        )))
        return F.concat(F.array(piece(head, F.lit(False))), bodies, F.array(piece(F.lit(END), F.lit(False))))

    return F.flatten(F.transform(messages, message))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, segments, formatted`` per conversation of ``(conv_id, turn, role, text)``."""
    empty = F.lit("")
    turn = F.struct(
        F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    grouped = conversations.select("conv_id", turn.alias("one")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("one")).alias("turns")
    )
    return grouped.select("conv_id", _runs(F.col("turns")).alias("messages")).select(
        "conv_id", _segments(F.col("messages"), loss_role).alias("segments")
    ).withColumn("formatted", _joined(F.transform("segments", lambda s: s["text"])))


def read_turns(formatted: Column) -> Column:
    """The turns ``role, text`` of a formatted conversation."""
    messages = F.filter(F.split(formatted, _literal(END)), lambda m: m != "")

    def turns(message: Column) -> Column:
        parts = F.split(message, _literal(TEXT))
        role = unescaped(F.substr(parts[0], F.lit(len(TURN) + 1)))
        return F.transform(F.split(parts[1], _literal(MORE)), lambda t: F.struct(
            role.alias("role"), unescaped(t).alias("text")
        ))

    return F.flatten(F.transform(messages, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return _joined(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])))
