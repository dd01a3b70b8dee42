"""What the conversation operators share: damage and rebuilding of a conversation table, and the digests of its turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.operators.ordered import running_totals

#: A conversation begins like the first of its ``FAMILY``, with up to ``HEADS - 1`` turns of it.
FAMILY = 20
HEADS = 4
#: One row in ``DAMAGED`` is dropped, emptied, and so on.
DAMAGED = 20


def or_space(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """``_conv``, ``_turn``, ``_role``, ``_text`` and ``_gone``: the rows after damage; a dropped row stays as a marker of its conversation."""
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % DAMAGED
    rows = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").cast("bigint").alias("_turn"), or_space("role").alias("_role"), or_space("text").alias("_text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    rows = rows.select("_conv", "_turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("_role"), text.alias("_text"), "_kind")
    copies = F.explode(F.array_repeat(F.col("_kind") == 0, F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("_conv", "_turn", "_role", "_text", copies.alias("_gone"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``_conv``, ``_at`` (place from 0), ``_a`` and ``_b`` (128 bits of role and text) and ``_words`` of every turn of a conversation that has an id.

    Turns are ordered by number, null first, then by role and a hash of the text.  Places are counted without holding a conversation in one task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("_conv"), F.col("turn").cast("bigint").alias("_turn"), role.alias("_role"),
        F.xxhash64(F.lit(1), role, text).alias("_a"), F.xxhash64(F.lit(2), F.char_length(role), text, role).alias("_b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("_words"), F.lit(1).alias("_one"), F.monotonically_increasing_id().alias("_read"),
    )
    placed = running_totals(rows, ["_turn", "_role", "_a", "_b", "_read"], ["_one"], ["_conv"])
    return placed.select("_conv", F.col("_one_before").alias("_at"), "_a", "_b", "_words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``numbered_turns`` in which conversation c begins with the first h turns of c - c % ``FAMILY``, h being crc32(c) % ``HEADS``, and goes on after its own first h."""
    first, taken = F.col("_conv") - F.col("_conv") % FAMILY, (F.crc32(F.col("_conv").cast("string").cast("binary")) % HEADS).cast("bigint")
    heads = turns.filter((F.col("_conv") == first) & (F.col("_at") < HEADS - 1))
    sizes = heads.groupBy(F.col("_conv").alias("_first")).agg(F.count("*").alias("_size"))
    known = turns.select("_conv").distinct().withColumns({"_first": first, "_taken": taken})
    borrowed = known.join(heads.withColumnRenamed("_conv", "_first"), "_first").filter(F.col("_at") < F.col("_taken")).select("_conv", "_at", "_a", "_b", "_words")
    shift = known.join(sizes, "_first", "left").select("_conv", "_taken", F.least("_taken", F.coalesce("_size", F.lit(0))).alias("_given"))
    own = turns.join(shift, "_conv").filter(F.col("_at") >= F.col("_taken"))
    return borrowed.unionByName(own.select("_conv", (F.col("_at") - F.col("_taken") + F.col("_given")).alias("_at"), "_a", "_b", "_words"))
