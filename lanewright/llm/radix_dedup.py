"""Exact duplicates by distributed most-significant-digit radix partitioning.

Texts are split into groups by their first bytes, each group by its next bytes, and so on, until a group is a single
row or all its texts have ended.  Equality follows from the bytes alone; no digest is compared.  One digit
is a run of bytes: the first is short, because it separates most texts, and each further one is longer, so that
long equal texts end after few rounds.  Groups are named by their smallest row number.  A round is one aggregate
with map-side combine (a group of copies becomes one row per task) and one join that carries the names back, which AQE
splits where a group is large.  Only what is left of the texts in open groups goes into the next round.

Null counts as the empty text, and all empty texts are one group.  Equality ignores the case of A-Z only.  Of equal texts the row with
the largest id is kept, a null id being smaller than any other; of equal ids, one row.  Repeated rows stay separate rows, of which one is
kept.  An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import lower_ascii
from lanewright.session import materialize

FIRST_DIGIT = 256
GROWTH = 8
LONGEST_DIGIT = 1 << 18


def _bytes(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit(""))).cast("binary")


def _split(docs: DataFrame, body: Column, first_digit: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose first digit no other row has, and the rest with a row number, ``_row``, written out."""
    rows = docs.withColumn("_digit", F.substr(body, F.lit(1), F.lit(first_digit)))
    shared = materialize(rows.groupBy("_digit").count().filter("count > 1").select("_digit"), "digits")
    # The hinted side holds digits only; the side with the texts is streamed, never sorted or copied to all tasks.
    alone = rows.join(shared.hint("shuffle_hash"), "_digit", "left_anti").drop("_digit")
    several = rows.join(shared.hint("shuffle_hash"), "_digit", "left_semi").drop("_digit")
    return alone, materialize(several.withColumn("_row", F.monotonically_increasing_id()), "radix")


def equal_groups(rows: DataFrame, body: Column, first_digit: int = FIRST_DIGIT) -> DataFrame:
    """``_row`` and ``_group`` for each row; equal bodies have the same group, the smallest row number among them."""
    open_rows = rows.select("_row", F.lit(0).cast("bigint").alias("_group"), body.alias("_rest"))
    parts, width = [], first_digit
    while not open_rows.isEmpty():
        level = open_rows.withColumn("_digit", F.substr("_rest", F.lit(1), F.lit(width)))
        split = level.groupBy("_group", "_digit").agg(F.min("_row").alias("_name"), F.count("*").alias("_n"))
        ended = (F.col("_n") == 1) | (F.octet_length("_digit") < width)
        named = materialize(
            level.join(split.hint("shuffle_hash"), ["_group", "_digit"]).select(
                "_row", F.col("_name").alias("_group"), ended.alias("_ended"),
                F.when(~ended, F.substr("_rest", F.lit(width + 1), F.octet_length("_rest"))).alias("_rest"),
            ),
            "radix",
        )
        parts.append(named.filter("_ended").select("_row", "_group"))
        open_rows = named.filter("not _ended").select("_row", "_group", "_rest")
        width = min(width * GROWTH, LONGEST_DIGIT)
    return reduce(DataFrame.union, parts) if parts else open_rows.select("_row", "_group")


def mark_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", first_digit: int = FIRST_DIGIT
) -> DataFrame:
    """Per row: ``id_column``, ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and ``text_sha256`` of the normalised bytes.

    The digest is a result only; it takes no part in finding equal texts.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.sha2(_bytes(F.col(text)), 256).alias("_sha"), F.col(text).alias("_text"))
    alone, several = _split(rows, _bytes(F.col("_text")), first_digit)
    members = several.select("_row", "_id", "_sha").join(equal_groups(several, _bytes(F.col("_text")), first_digit), "_row")
    members = materialize(members, "members")
    copies = members.groupBy("_group").agg(F.max(F.struct("_id", "_row")).alias("_best"), F.count("*").alias("_size"))
    several = members.join(copies, "_group").select(
        F.col("_id").alias(id_column), F.col("_best._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
    single = alone.select(
        F.col("_id").alias(id_column), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return single.unionByName(several)


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of equal texts."""
    body = _bytes(F.col("_whole").getField(text))
    alone, several = _split(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")), body, first_digit)
    members = several.select("_row", F.col("_whole").getField(id_column).alias("_id")).join(equal_groups(several, body, first_digit), "_row")
    best = members.groupBy("_group").agg(F.max(F.struct("_id", "_row")).alias("_best")).select(F.col("_best._row").alias("_row"))
    kept = several.join(materialize(best, "best").hint("shuffle_hash"), "_row", "left_semi")
    return alone.select("_whole.*").unionByName(kept.select("_whole.*"))
