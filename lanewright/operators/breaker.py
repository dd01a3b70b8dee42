"""The error-rate breaker over whole batches, routing, and the incident log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.numbers import rnd_total
from lanewright.policy import BreakerPolicy

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"
TRIPPED, RESOLVED, ROLLED_BACK = "TRIPPED_ROUTED_DLQ", "RESOLVED", "ROLLED_BACK"
INCIDENT_PREFIX = "INC-2026-"  # fixed value
REASON = (
    "Stream error rate (%s%%) exceeded safety threshold (%s%%). Flink routed stream to DLQ Iceberg table [%s]."
)  # fixed value
UNKNOWN_DURATION = 180  # fixed value: seconds shown for a closed incident without a stored duration


def batch_counts(events: DataFrame, node: str, batch: str, is_error: Column) -> DataFrame:
    """Counts per (node, batch).  All later windows run on these, not on events."""
    return events.groupBy(F.col(node).alias("node"), F.col(batch).alias("batch_id")).agg(
        F.count("*").alias("total"), F.count_if(is_error).alias("errors")
    )


def with_epochs(counts: DataFrame, resets: DataFrame | None) -> DataFrame:
    """Adds ``epoch``: the number of manual resets of the node up to and before this batch is counted."""
    if resets is None:
        return counts.withColumn("epoch", F.lit(0).cast("bigint"))
    marks = resets.select("node", "batch_id").distinct().withColumn("_reset", F.lit(1))
    so_far = Window.partitionBy("node").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = counts.join(marks, ["node", "batch_id"], "full")  # a reset may fall on a node's idle batch
    numbered = joined.withColumn("epoch", F.sum(F.coalesce("_reset", F.lit(0))).over(so_far))
    return numbered.filter("total is not null").drop("_reset")


def running_error_rate(counts: DataFrame, policy: BreakerPolicy = BreakerPolicy()) -> DataFrame:
    """Cumulative totals and error rate per (node, epoch); negative batch counts add nothing."""
    base = counts if "epoch" in counts.columns else with_epochs(counts, None)
    w = Window.partitionBy("node", "epoch").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("epoch") == 0, policy.base_errors).otherwise(policy.reset_errors)
    total = F.sum(F.greatest("total", F.lit(0))).over(w) + policy.base_total
    errors = F.sum(F.greatest("errors", F.lit(0))).over(w) + start
    rate = F.coalesce(F.try_divide(F.col("error_events") * 100, F.col("total_events")), F.lit(0.0))
    return base.withColumn("total_events", total).withColumn("error_events", errors).withColumn("error_rate", rnd_total(rate, 2))


def breaker_states(counts: DataFrame, policy: BreakerPolicy = BreakerPolicy(), resets: DataFrame | None = None) -> DataFrame:
    """State after every batch, in closed form.

    Per node and epoch: the last batch whose rate was too high opens the breaker;
    the first error-free batch after it half-opens; the next one closes.
    """
    rated = running_error_rate(with_epochs(counts, resets), policy)
    bad = F.col("error_rate") > policy.threshold
    w = Window.partitionBy("node", "epoch").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("node", "epoch", "last_bad").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = rated.withColumn("last_bad", F.max(F.when(bad, F.col("batch_id"))).over(w))
    marked = marked.withColumn("first_clean", F.min(F.when(~bad & (F.col("errors") == 0), F.col("batch_id"))).over(since))
    state = (
        F.when(F.col("last_bad").isNull(), CLOSED)
        .when(F.col("first_clean").isNull(), OPEN)
        .when(F.col("batch_id") == F.col("first_clean"), HALF_OPEN)
        .otherwise(CLOSED)
    )
    return marked.withColumn("state", state).drop("last_bad", "first_clean")


def state_changes(states: DataFrame) -> DataFrame:
    """Batches after which the state differs from before; a node and every reset start CLOSED."""
    before = F.lag("state", 1, CLOSED).over(Window.partitionBy("node", "epoch").orderBy("batch_id"))
    return states.withColumn("previous_state", before).filter("previous_state <> state")


def destination(policy: BreakerPolicy) -> Column:
    return F.when(F.col("state") == OPEN, policy.dlq_table).otherwise(policy.main_table)


def route_records(events: DataFrame, states: DataFrame, policy: BreakerPolicy = BreakerPolicy()) -> DataFrame:
    """Every event with the table it goes to: the state after its batch was counted decides."""
    decided = states.select("node", "batch_id", destination(policy).alias("destination"))
    return events.join(decided, ["node", "batch_id"])


def split_routes(routed: DataFrame, policy: BreakerPolicy = BreakerPolicy()) -> tuple[DataFrame, DataFrame]:
    return routed.filter(F.col("destination") == policy.main_table), routed.filter(F.col("destination") == policy.dlq_table)


def breaker_status(states: DataFrame, policy: BreakerPolicy = BreakerPolicy()) -> DataFrame:
    """The latest state of each node with its colour and active route."""
    facts = F.struct("batch_id", "state", "error_rate", "total_events", "error_events")
    last = states.groupBy("node").agg(F.max_by(facts, F.col("batch_id")).alias("s")).select("node", "s.*")
    tripped = F.col("state") == OPEN
    return last.select(
        "*",
        F.when(tripped, "RED_ALERT").otherwise("GREEN_HEALTHY").alias("node_status"),
        destination(policy).alias("active_route"),
        tripped.alias("dlq_active"),
    )


def open_incidents(states: DataFrame, policy: BreakerPolicy = BreakerPolicy(), only_changes: bool = False, digits: int = 16) -> DataFrame:
    """An incident row per tripped batch, or per trip with ``only_changes``.

    The code is a hash of node and batch, so a replay yields the same code.
    """
    tripped = (state_changes(states) if only_changes else states).filter(F.col("state") == OPEN)
    code = F.upper(F.substring(F.sha2(F.concat_ws("|", "node", F.col("batch_id").cast("string")), 256), 1, digits))
    reason = F.format_string(
        REASON, F.col("error_rate").cast("string"), F.lit(float(policy.threshold)).cast("string"), F.lit(policy.dlq_table)
    )
    return tripped.select(
        F.concat(F.lit(INCIDENT_PREFIX), code).alias("incident_code"),
        F.col("node").alias("pipeline_node"),
        "batch_id",
        "error_rate",
        F.lit(float(policy.threshold)).alias("threshold"),
        F.lit(TRIPPED).alias("status"),
        reason.alias("trigger_reason"),
        F.lit(policy.dlq_table).alias("dlq_table_name"),
        F.col("last_ts").alias("paused_at"),
        F.lit(None).cast("timestamp").alias("resumed_at"),
        F.lit(None).cast("bigint").alias("duration_seconds"),
    )


def _seconds(later: Column, earlier: Column) -> Column:
    return F.floor(later.cast("double") - earlier.cast("double"))


def close_incidents(incidents: DataFrame, now: str, status: str = RESOLVED) -> DataFrame:
    """Open incidents get the status, the time and their duration; others stay as they are."""
    end = F.lit(now).cast("timestamp")
    is_open = F.col("status") == TRIPPED
    return incidents.withColumns(
        {
            "status": F.when(is_open, status).otherwise(F.col("status")),
            "resumed_at": F.when(is_open, end).otherwise(F.col("resumed_at")),
            "duration_seconds": F.when(is_open & F.col("paused_at").isNotNull(), _seconds(end, F.col("paused_at"))).otherwise(
                F.col("duration_seconds")
            ),
        }
    )


def resolve_incidents(incidents: DataFrame, now: str) -> DataFrame:
    return close_incidents(incidents, now, RESOLVED)


def rollback_incidents(incidents: DataFrame, now: str) -> DataFrame:
    return close_incidents(incidents, now, ROLLED_BACK)


def incident_history(incidents: DataFrame, now: str) -> DataFrame:
    """Incidents, newest first, with a duration for every row."""
    end = F.lit(now).cast("timestamp")
    running = (F.col("status") == TRIPPED) & F.col("paused_at").isNotNull()
    shown = (
        F.when(F.col("duration_seconds") != 0, F.col("duration_seconds"))
        .when(running, _seconds(end, F.col("paused_at")))
        .otherwise(F.lit(UNKNOWN_DURATION))
    )
    return incidents.withColumn("duration_seconds", shown.cast("bigint")).orderBy(F.col("batch_id").desc(), "incident_code")
