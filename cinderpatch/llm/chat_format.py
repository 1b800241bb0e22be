"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs and sorted. Runs of the same role become one block by array
aggregation: the places where the role changes cut the array into slices, and each slice is folded into a role and
its texts. The border of two merged turns keeps a mark of its own, so reading back gives every turn. Texts are escaped so that no control string can occur inside them.

A block is ``<|im_start|>role\\ntext<|im_end|>\\n``; merged texts stand apart by ``<|turn|>``. In texts and
roles ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; a line feed in a role becomes ``<|nl|>``.

Defined results: null text and null role are the empty string; turns with the same number are ordered
by role and text; a null turn comes first; repeated rows are turns of their own; rows with a null
conversation form one conversation with a null id; very long texts and conversations cost time in
proportion; an empty table gives an empty result; other columns are ignored. One conversation becomes one string, so it must fit a row (2 GB); that is the only group
that meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

# The control strings.
START, END, TURN, LINE = "<|im_start|>", "<|im_end|>", "<|turn|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _blocks(turns: Column) -> Column:
    """array<struct<role, texts>> of sorted turns: a block for each run of a role."""

    def cut(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        changes = F.filter(places, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        return let(
            changes,
            lambda starts: F.transform(
                starts,
                lambda start, n: let(
                    F.slice(t, start + 1, F.coalesce(F.get(starts, n + 1), F.size(t)) - start),
                    lambda run: F.struct(run[0]["role"].alias("role"), F.transform(run, lambda x: x["text"]).alias("texts")),
                ),
            ),
        )

    return let(turns, cut)


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row per conversation: key, formatted, and loss_spans array<struct<start, length>>: the code
    points of ``formatted`` (from 0) under the loss mask, one span per turn of the role ``learn``."""
    rows = turns.select(
        F.col(conv).alias("key"),
        F.struct(
            F.col(turn).alias("turn"),
            F.replace(escape(F.coalesce(F.col(role).cast("string"), F.lit(""))), F.lit("\n"), F.lit(LINE)).alias("role"),
            escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
        ).alias("turn"),
    )
    sorted_turns = rows.groupBy("key").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    merged = sorted_turns.select("key", _blocks(F.col("turns")).alias("blocks"))
    # A turn's text, with the control strings before and behind it.
    parts = merged.select(
        "key",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.transform(
                    b["texts"],
                    lambda x, i: F.struct(
                        F.when(i == 0, F.concat(F.lit(START), b["role"], F.lit("\n"))).otherwise(TURN).alias("lead"),
                        x.alias("text"),
                        F.when(i == F.size(b["texts"]) - 1, END + "\n").otherwise("").alias("tail"),
                        (b["role"] == learn).alias("learn"),
                    ),
                ),
            )
        ).alias("parts"),
    )
    placed = running(
        F.col("parts"),
        lambda p: F.length(p["lead"]) + F.length(p["text"]) + F.length(p["tail"]),
        lambda at, p: F.struct((at + F.length(p["lead"])).alias("start"), F.length(p["text"]).alias("length"), p["learn"].alias("learn")),
        "struct<start:int,length:int,learn:boolean>",
    )
    spans = F.transform(F.filter(placed, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["length"]))
    return parts.select(
        "key",
        F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["text"], p["tail"])), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: every turn, unescaped, from the formatted string alone."""
    # Literal patterns: \Q..\E. The first piece is what stands before the first start mark.
    blocks = F.split(formatted, rf"\Q{START}\E", -1)
    per_block = F.transform(
        F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))),
        lambda b: let(
            F.instr(b, "\n"),
            lambda at: let(
                F.regexp_replace(F.replace(F.substring(b, F.lit(1), at - 1), F.lit(LINE), F.lit("\n")), r"\\([\\|])", "$1"),
                lambda role: F.transform(
                    F.split(F.substring(b, at + 1, F.length(b) - at - len(END) - 1), rf"\Q{TURN}\E", -1),
                    lambda text: F.struct(role.alias("role"), unescape(text).alias("text")),
                ),
            ),
        ),
    )
    return F.flatten(per_block)


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), ""
    )
