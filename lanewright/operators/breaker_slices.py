"""The breaker over one node's whole history, spread over slices.

``breaker.breaker_states`` runs windows per node, so a node with most of the batches is one task.  Here every step is a running total or an aggregate:
a slice of consecutive batches is summed up by its totals and its last bad batch, these summaries are folded from left to right, and each slice is finished
from what came before it.  The clean batch that half-opens is the least one after a bad batch, one row for each bad batch, found with a map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.functions.numbers import rnd_total
from lanewright.operators.breaker import CLOSED, HALF_OPEN, OPEN
from lanewright.operators.ordered import running_totals
from lanewright.policy import BreakerPolicy


def with_epochs(counts: DataFrame, resets: DataFrame | None, slices: int | None = None) -> DataFrame:
    """Adds ``epoch``, the resets of the node up to and including the batch; also those of batches without events."""
    if resets is None:
        return counts.withColumn("epoch", F.lit(0).cast("bigint"))
    marks = resets.select("node", "batch_id").distinct().withColumn("_reset", F.lit(1).cast("bigint"))
    joined = counts.join(marks, ["node", "batch_id"], "full").withColumn("_reset", F.coalesce("_reset", F.lit(0).cast("bigint")))
    numbered = running_totals(joined, ["batch_id"], ["_reset"], ["node"], slices)
    return numbered.filter("total is not null").withColumn("epoch", F.col("_reset_before") + F.col("_reset")).drop("_reset", "_reset_before")


def sliced_states(counts: DataFrame, policy: BreakerPolicy = BreakerPolicy(), resets: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """The rows of ``breaker.breaker_states``, with no task holding more than a slice of a node."""
    zero = F.lit(0).cast("bigint")
    rows = with_epochs(counts, resets, slices).withColumns({"_n": F.greatest("total", zero), "_bad": F.greatest("errors", zero)})
    rows = running_totals(rows, ["batch_id"], ["_n", "_bad"], ["node", "epoch"], slices)
    start = F.when(F.col("epoch") == 0, policy.base_errors).otherwise(policy.reset_errors)
    rows = rows.withColumns({"total_events": F.col("_n_before") + F.col("_n") + policy.base_total, "error_events": F.col("_bad_before") + F.col("_bad") + start})
    rate = F.coalesce(F.try_divide(F.col("error_events") * 100, F.col("total_events")), F.lit(0.0))
    rows = rows.drop("_n", "_bad", "_n_before", "_bad_before").withColumn("error_rate", rnd_total(rate, 2))
    over = F.col("error_rate") > policy.threshold
    rows = running_totals(rows.withColumn("_trip", F.when(over, F.col("batch_id"))), ["batch_id"], ["_trip"], ["node", "epoch"], slices, fold="max")
    rows = rows.withColumn("_last", F.greatest("_trip_before", "_trip"))
    clean = rows.filter(~over & (F.col("errors") == 0) & F.col("_last").isNotNull()).groupBy("node", "epoch", "_last").agg(F.min("batch_id").alias("_clean"))
    rows = rows.join(clean, ["node", "epoch", "_last"], "left")
    state = (
        F.when(F.col("_last").isNull(), CLOSED)
        .when(F.col("_clean").isNull() | (F.col("batch_id") < F.col("_clean")), OPEN)
        .when(F.col("batch_id") == F.col("_clean"), HALF_OPEN)
        .otherwise(CLOSED)
    )
    return rows.withColumn("state", state).drop("_trip", "_trip_before", "_last", "_clean")
