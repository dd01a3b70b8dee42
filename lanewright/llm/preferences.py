"""Preference formatting: one prompt for a chosen and a rejected conversation, and their completions with masks.

The turns that both conversations share from the start (same role and text, in order) are the prompt and are rendered once; what follows in
each is its completion.  The mask of a completion lists the spans of its characters that a model is trained on: the
text and end mark of each assistant turn, never a role header and never a turn of another role.

Roles and texts that are null count as empty.  Turns are ordered by their number, a null number first; turns with the same number by role and text.  A
pair whose two conversations are equal has empty completions and an empty mask; if one is the start of the other, its completion is
empty.  A pair that lacks a side is formatted with that side empty.  Repeated rows of a turn are repeated turns.  A conversation is
gathered into one row, so one conversation must fit in memory; conversations that share their turns never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The layout of a turn.
HEADER_START, HEADER_END, TURN_END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``_id`` and ``_turns``, an array of (role, text) in order."""
    item = F.struct(
        F.col(f"`{turn}`").alias("n"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    gathered = turns.groupBy(F.col(f"`{id_column}`").alias("_id")).agg(F.array_sort(F.collect_list(item)).alias("_turns"))
    return gathered.withColumn("_turns", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(HEADER_START), turn["role"], F.lit(HEADER_END))


def render(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(TURN_END))), "")


def mask(turns: Column) -> Column:
    """Spans (start, end) in characters of what ``render`` makes of the turns, for the turns that are trained on."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first = state["at"] + F.char_length(_header(t))
        end = first + F.char_length(t["text"]) + len(TURN_END)
        span = F.array(F.struct(first.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda state: state["spans"])


def common_turns(left: Column, right: Column) -> Column:
    """How many turns two conversations share from the start: the place of the first difference."""
    shorter = F.least(F.size(left), F.size(right))
    same = F.zip_with(F.slice(left, F.lit(1), shorter), F.slice(right, F.lit(1), shorter), lambda a, b: a == b)
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(shorter).cast("int")


def format_pairs(pairs: DataFrame, turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: conversation ids) with ``n_common``, ``prompt``, and text and mask of both completions."""
    talks = conversations(turns, id_column)
    none = F.array().cast("array<struct<role:string,text:string>>")
    joined = pairs.select("pair_id", "chosen", "rejected")
    for side in ("chosen", "rejected"):
        named = talks.select(F.col("_id").alias(f"_{side}_id"), F.col("_turns").alias(f"_{side}"))
        joined = joined.join(named, F.col(side) == F.col(f"_{side}_id"), "left").drop(f"_{side}_id")
        joined = joined.withColumn(f"_{side}", F.coalesce(F.col(f"_{side}"), none))
    shared = joined.withColumn("n_common", common_turns(F.col("_chosen"), F.col("_rejected")))
    rest = {side: F.slice(F.col(f"_{side}"), F.col("n_common") + 1, F.size(f"_{side}") + 1) for side in ("chosen", "rejected")}
    return shared.select(
        "pair_id", "chosen", "rejected", "n_common", render(F.slice("_chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        *[c.alias(f"{side}_{name}") for side, x in rest.items() for name, c in (("text", render(x)), ("mask", mask(x)))],
    )


def opening_pairs(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Pairs for a table that names none: conversations ``2k`` and ``2k + 1``; the one with more turns, else the first, is chosen.

    A conversation without its partner gives no pair, and neither does a null id.
    """
    sizes = turns.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("bigint").alias("_id")).agg(F.count("*").alias("_n"))
    better = F.struct(F.col("_n"), -F.col("_id"))
    sides = sizes.groupBy(F.floor(F.col("_id") / 2).cast("bigint").alias("pair_id")).agg(
        F.max_by("_id", better).alias("chosen"), F.min_by("_id", better).alias("rejected"), F.count("*").alias("_sides")
    )
    return sides.filter("_sides = 2").select("pair_id", "chosen", "rejected")
