"""Text rules: search, note checks, the assistant's reply and the ROI sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions.risk import positive_or


def search_filter(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows where any of the columns contains the term, ignoring case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False))
    return df.filter(found)


def notes_valid(note: Column, shortest: int = 10) -> Column:
    return F.coalesce(F.length(F.trim(note)) >= shortest, F.lit(False))


def intent(prompt: Column) -> Column:
    """First keyword rule that matches anywhere in the prompt, also inside a longer word."""
    low = F.lower(prompt)
    expr = None
    for name, words in P.INTENT_KEYWORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(P.INTENT_OTHER)


def _fill(template: str, parts: dict[str, Column]) -> Column:
    """Turn a reply with {x} marks into a concat of literals and columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            pieces.append(F.lit(rest))
            break
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(parts[rest[start + 1]])
        rest = rest[start + 3 :]
    return F.concat(*pieces)


def route_intent(prompts: DataFrame) -> DataFrame:
    """Add ``intent`` and ``reply`` to rows of prompt, warehouse_id, zone, dist_from_hub, product_wg_ton."""
    name = F.col("warehouse_id")
    parts = {
        "w": F.when(name != "", name).otherwise(P.ASSISTANT_WAREHOUSE),
        "z": F.coalesce(F.col("zone"), F.lit(P.ASSISTANT_ZONE)),
        "d": positive_or(F.col("dist_from_hub"), P.DEFAULT_DISTANCE).cast("string"),
        "t": F.format_number(positive_or(F.col("product_wg_ton"), P.DEFAULT_WEIGHT), 0),
    }
    replies = None
    for key, template in P.INTENT_REPLY.items():
        text = _fill(template, parts)
        replies = F.when(F.col("intent") == key, text) if replies is None else replies.when(F.col("intent") == key, text)
    return prompts.withColumn("intent", intent(F.col("prompt"))).withColumn("reply", replies)


def _amount(value: Column) -> Column:
    """Thousands separators and up to three decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(value, 3), "0+$", ""), r"\.$", "")


def _plain(value: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def roi_narrative(totals: DataFrame) -> DataFrame:
    """One sentence from a row of ROI totals."""
    savings, gain = F.col("total_cost_savings"), F.col("avg_delay_improvement")
    counts = F.format_string(
        P.ROI_COUNTS, F.col("evaluated_outcomes"), F.col("positive_outcomes"), _plain(F.col("positive_outcome_rate"))
    )
    money = F.when(savings > 0, F.format_string(P.ROI_SAVED, _amount(savings))).otherwise(
        F.format_string(P.ROI_OVERSPENT, _amount(F.abs(savings)))
    )
    days = F.when(gain > 0, F.format_string(P.ROI_EARLIER, _plain(gain))).otherwise(
        F.format_string(P.ROI_LATER, _plain(F.abs(gain)))
    )
    return totals.select(
        F.when(F.col("evaluated_outcomes") == 0, P.ROI_NOTHING).otherwise(F.concat(counts, money, days)).alias("narrative")
    )
