"""Queries for the stream breaker, incidents and table versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lanewright.operators import breaker, breaker_slices, sets, versions
from lanewright.plans.bindings import SCHEMAS
from lanewright.plans.registry import query, rounded as R
from lanewright.policy import BreakerPolicy
from lanewright.session import shared_folder
from lanewright.sources.snapshots import SnapshotStore
from lanewright.streaming import breaker_stream as live

POLICY = BreakerPolicy(threshold=25.0, base_total=0, base_errors=0, reset_errors=0)
NOW = "2024-03-01 00:00:00"


def states_sql(resets: bool = False, policy: BreakerPolicy = POLICY) -> str:
    epochs = (
        """select c.*, cast((select count(*) from {node_resets} r where r.node = c.node and r.batch_id <= c.batch_id) as bigint) as epoch from {batch_counts} c"""
        if resets
        else "select c.*, cast(0 as bigint) as epoch from {batch_counts} c"
    )
    w = "partition by node, epoch order by batch_id"
    return f"""
ep as ({epochs}),
run as (select *, sum(total) over ({w}) + {policy.base_total} as tt, sum(errors) over ({w}) + case when epoch = 0 then {policy.base_errors} else {policy.reset_errors} end as ee from ep),
rate as (select *, {R('100e0 * ee / tt', 2)} as error_rate from run),
lb as (select *, max(case when error_rate > {policy.threshold} then batch_id end) over ({w}) as last_bad from rate),
fz as (select *, min(case when error_rate <= {policy.threshold} and errors = 0 then batch_id end) over (partition by node, epoch, last_bad order by batch_id) as first_clean from lb),
states as (select node, batch_id, total, errors, last_ts, epoch, cast(tt as bigint) as total_events, cast(ee as bigint) as error_events, error_rate,
  case when last_bad is null then 'CLOSED' when first_clean is null then 'OPEN' when batch_id = first_clean then 'HALF_OPEN' else 'CLOSED' end as state from fz)"""


def states(t, resets: bool = False):
    return breaker.breaker_states(t("batch_counts"), POLICY, t("node_resets") if resets else None)


@query("running_error_rate", f"with {states_sql()} select node, batch_id, total_events, error_events, error_rate from states")
def running_error_rate(t):
    return breaker.running_error_rate(t("batch_counts"), POLICY).select("node", "batch_id", "total_events", "error_events", "error_rate")


@query("breaker_states", f"with {states_sql()} select node, batch_id, error_rate, state from states")
def breaker_states(t):
    return states(t).select("node", "batch_id", "error_rate", "state")


@query("reset_epoch", f"with {states_sql(True)} select node, batch_id, epoch, total_events, error_events, state from states")
def reset_epoch(t):
    return states(t, resets=True).select("node", "batch_id", "epoch", "total_events", "error_events", "state")


@query("breaker_states_sliced", f"with {states_sql(True)} select node, batch_id, epoch, total_events, error_events, error_rate, state from states")
def breaker_states_sliced(t):
    """The same states by running totals over slices, for nodes whose history no task should hold."""
    made = breaker_slices.sliced_states(t("batch_counts"), POLICY, t("node_resets"))
    return made.select("node", "batch_id", "epoch", "total_events", "error_events", "error_rate", "state")


@query("state_changes", f"""with {states_sql()} select node, batch_id, state, previous_state from (
  select *, coalesce(lag(state) over (partition by node, epoch order by batch_id), 'CLOSED') as previous_state from states) x where previous_state <> state""")
def state_changes(t):
    return breaker.state_changes(states(t)).select("node", "batch_id", "state", "previous_state")


@query("route_records", f"""with {states_sql()}
select e.event_id, e.event_type, case when s.state = 'OPEN' then 'warehouses_dlq_stream' else 'warehouses_main_stream' end as destination
from events e join states s on s.node = 'node-' || cast(e.user_id as string) and s.batch_id = cast(year(e.ts) * 10000 + month(e.ts) * 100 + day(e.ts) as bigint)""")
def route_records(t):
    events = t("events").select(
        "event_id", "event_type", F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("node"),
        (F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")).cast("bigint").alias("batch_id"),
    )
    return breaker.route_records(events, states(t), POLICY).select("event_id", "event_type", "destination")


@query("breaker_status", f"""with {states_sql()} select node, batch_id, state, error_rate, total_events, error_events,
  case when state = 'OPEN' then 'RED_ALERT' else 'GREEN_HEALTHY' end as node_status,
  case when state = 'OPEN' then 'warehouses_dlq_stream' else 'warehouses_main_stream' end as active_route, state = 'OPEN' as dlq_active
from (select *, row_number() over (partition by node order by batch_id desc) as rn from states) x where rn = 1""")
def breaker_status(t):
    return breaker.breaker_status(states(t), POLICY)


INCIDENTS_CTE = f"""{states_sql()},
inc as (select 'INC-2026-' || upper(substr(sha256(node || '|' || cast(batch_id as string)), 1, 16)) as incident_code, node as pipeline_node, batch_id, error_rate, 25e0 as threshold,
  'TRIPPED_ROUTED_DLQ' as status, 'Stream error rate (' || cast(error_rate as string) || '%) exceeded safety threshold (25.0%). Flink routed stream to DLQ Iceberg table [warehouses_dlq_stream].' as trigger_reason,
  'warehouses_dlq_stream' as dlq_table_name, last_ts as paused_at from states where state = 'OPEN')"""


def _incidents(t):
    return breaker.open_incidents(states(t), POLICY)


@query("open_incidents", f"with {INCIDENTS_CTE} select incident_code, pipeline_node, batch_id, error_rate, threshold, status, trigger_reason, dlq_table_name from inc")
def open_incidents(t):
    return _incidents(t).drop("paused_at", "resumed_at", "duration_seconds")


def _closed_sql(status: str) -> str:
    return f"""with {INCIDENTS_CTE} select incident_code, '{status}' as status, '{NOW}' as resumed_at,
  cast(floor(epoch(timestamp '{NOW}') - epoch(paused_at)) as bigint) as duration_seconds from inc"""


def _closed(frame):
    return frame.select("incident_code", "status", F.date_format("resumed_at", "yyyy-MM-dd HH:mm:ss").alias("resumed_at"), "duration_seconds")


@query("resolve_incidents", _closed_sql("RESOLVED"))
def resolve_incidents(t):
    return _closed(breaker.resolve_incidents(_incidents(t), NOW))


@query("rollback_incidents", _closed_sql("ROLLED_BACK"))
def rollback_incidents(t):
    return _closed(breaker.rollback_incidents(_incidents(t), NOW))


@query("incident_history", f"""with {INCIDENTS_CTE} select incident_code, pipeline_node, batch_id, status,
  cast(floor(epoch(timestamp '{NOW}') - epoch(paused_at)) as bigint) as duration_seconds from inc""")
def incident_history(t):
    return breaker.incident_history(_incidents(t), NOW).select("incident_code", "pipeline_node", "batch_id", "status", "duration_seconds")


WINDOW_SQL = f"""
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as total, count(case when event_type = 'error' then 1 end) as errors,
  {R("count(case when event_type = 'error' then 1 end) * 1e2 / count(*)", 2)} as error_rate from events group by date_trunc('day', ts)"""


@query("windowed_error_rate", WINDOW_SQL)
def windowed_error_rate(t):
    made = live.windowed_error_rate(t("events"), "ts", F.col("event_type") == "error", "1 day")
    return made.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("sliding_error_rate", f"""
with hours as (select ts, event_type, unnest([0, 1, 2, 3, 4, 5]) as back from events),
placed as (select date_trunc('hour', ts) - to_hours(cast(back as int)) as start, event_type from hours)
select strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as total, count(case when event_type = 'error' then 1 end) as errors,
  {R("count(case when event_type = 'error' then 1 end) * 1e2 / count(*)", 2)} as error_rate from placed group by start""")
def sliding_error_rate(t):
    made = live.windowed_error_rate(t("events"), "ts", F.col("event_type") == "error", "6 hours", "1 hour")
    return made.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


# --- live twins: the check SQL states the batch result -----------------------------
def _event_stream(t):
    return live.read_stream(t.spark, t.sf_dir, SCHEMAS["events"], "events.parquet")


LATE = "2 days"


def event_columns():
    """Node, batch (the day), error flag and end of the batch of an event."""
    node, day = F.concat(F.lit("node-"), F.col("user_id").cast("string")), F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")
    return node, day, F.col("event_type") == "error", F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("interval 1 day")


def _evaluations(t):
    return live.evaluate_batch_stream(_event_stream(t), *event_columns()[:3], POLICY)


def _timed(t):
    return live.timed_counts(_event_stream(t), *event_columns())


@query("stream_source", "select event_id, event_type, value from events")
def stream_source(t):
    return live.run_to_table(_event_stream(t).select("event_id", "event_type", "value"), "source", "append").drop("epoch")


@query("evaluate_batch_stream", f"""with {states_sql()}
select node, batch_id, total, errors, total_events, error_events, error_rate, state, coalesce(lag(state) over (partition by node order by batch_id), 'CLOSED') as previous_state,
  case state when 'OPEN' then 'warehouses_dlq_stream' else 'warehouses_main_stream' end as destination from states""")
def evaluate_batch_stream(t):
    evaluated = live.evaluate_timed_stream(_timed(t), LATE, POLICY)
    return live.latest(live.run_to_table(evaluated, "breaker"), ["node", "batch_id"]).drop("reset_epoch")


REFERENCE_POLICY = BreakerPolicy()


@query("breaker_reference_policy", f"with {states_sql(True, BreakerPolicy(2.0, 1000, 5, 4))} select node, batch_id, epoch, total_events, error_events, error_rate, state from states")
def breaker_reference_policy(t):
    """The limit of 2 %, a start from 1000 events with 5 errors, and restarts from 1000 with 4."""
    made = breaker.breaker_states(t("batch_counts"), REFERENCE_POLICY, t("node_resets"))
    return made.select("node", "batch_id", "epoch", "total_events", "error_events", "error_rate", "state")


@query("reset_flow", f"with {states_sql(True, BreakerPolicy(2.0, 1000, 5, 4))} select node, batch_id, epoch, total_events, error_events, error_rate, state from states")
def reset_flow(t):
    """Trips, manual resets and further trips on a live stream: the resets are a stream of their own, joined with the events in one state."""
    folder = f"{shared_folder(t.spark)}/resets-{uuid.uuid4().hex}"
    t("node_resets").select("node", "batch_id").write.parquet(folder)
    resets = live.read_stream(t.spark, folder, "node string, batch_id bigint")
    ends = F.to_timestamp(F.col("batch_id").cast("string"), "yyyyMMdd") + F.expr("interval 1 day")
    rows = _timed(t).unionByName(live.timed_marks(resets, F.col("node"), F.col("batch_id"), ends))
    made = live.latest(live.run_to_table(live.evaluate_timed_stream(rows, LATE, REFERENCE_POLICY), "resets"), ["node", "batch_id"])
    return made.withColumnRenamed("reset_epoch", "epoch").select("node", "batch_id", "epoch", "total_events", "error_events", "error_rate", "state")


@query("windowed_error_rate_stream", WINDOW_SQL)
def windowed_error_rate_stream(t):
    made = live.windowed_error_rate(_event_stream(t), "ts", F.col("event_type") == "error", "1 day", late="1 hour")
    found = live.latest(live.run_to_table(made, "windows"), ["window_start"])
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("state_change_feed", f"""with {states_sql()},
moves as (select node, batch_id, coalesce(lag(state) over (partition by node order by batch_id), 'CLOSED') as previous_state, state from states)
select * from moves where previous_state <> state""")
def state_change_feed(t):
    folder = f"{shared_folder(t.spark)}/feed-{uuid.uuid4().hex}"

    def keep(changes, epoch):
        # A replayed micro-batch overwrites its own folder.
        changes.select("node", "batch_id", "previous_state", "state").write.mode("overwrite").parquet(f"{folder}/changes/epoch={epoch}")

    live.state_change_feed(_evaluations(t), [keep], f"{folder}/log").awaitTermination()
    return t.spark.read.parquet(f"{folder}/changes").drop("epoch")


# --- table versions ---------------------------------------------------------------
@query("snapshot_history", "select snapshot_id, table_name, record_count, status, is_current from {snapshot_manifest} where table_name = 'warehouses_main_stream'")
def snapshot_history(t):
    rows = versions.snapshot_history(t("snapshot_manifest"), "warehouses_main_stream")
    return rows.select("snapshot_id", "table_name", "record_count", "status", "is_current")


@query("current_snapshot", "select snapshot_id, table_name, seq, record_count, status from {snapshot_manifest} where is_current order by seq limit 1")
def current_snapshot(t):
    return versions.current_snapshot(t("snapshot_manifest")).select("snapshot_id", "table_name", "seq", "record_count", "status")


@query("snapshot_lineage", """
with recursive up as (select snapshot_id, snapshot_id as root_snapshot_id, cast(0 as bigint) as depth from {snapshot_manifest}
    where parent_snapshot_id is null or parent_snapshot_id not in (select snapshot_id from {snapshot_manifest})
  union all select m.snapshot_id, u.root_snapshot_id, u.depth + 1 from {snapshot_manifest} m join up u on u.snapshot_id = m.parent_snapshot_id)
select snapshot_id, root_snapshot_id, depth from up""")
def snapshot_lineage(t):
    return versions.snapshot_lineage(t("snapshot_manifest"))


@query("pre_anomaly_snapshot", f"""with {INCIDENTS_CTE}
select incident_code, (select max_by(snapshot_id, committed_at) from {{snapshot_manifest}} m
  where m.status = 'VALID' and m.table_name = 'warehouses_main_stream' and m.committed_at < i.paused_at) as pre_anomaly_snapshot_id from inc i""")
def pre_anomaly_snapshot(t):
    return versions.pre_anomaly_snapshot(t("snapshot_manifest"), _incidents(t))


def _as_of_sql(seq: str) -> str:
    return f"""select node, commit_seq, change_no, status, reading from (
  select *, row_number() over (partition by node order by commit_seq desc, change_no desc) as rn from {{commits}} where commit_seq <= {seq}) x where rn = 1"""


@query("time_travel", _as_of_sql("20240115"))
def time_travel(t):
    return versions.as_of(t("commits"), "node", 20240115)


@query("snapshot_diff", f"""
with a as ({_as_of_sql('20240110')}), b as ({_as_of_sql('20240115')}), plus as (select * from b except all select * from a), minus as (select * from a except all select * from b)
select node, commit_seq, change_no, status, reading, 'added' as change, cast(1 as bigint) as copies from plus
union all select node, commit_seq, change_no, status, reading, 'removed', cast(1 as bigint) from minus""")
def snapshot_diff(t):
    log = t("commits")
    return sets.row_diff(versions.as_of(log, "node", 20240110), versions.as_of(log, "node", 20240115))


def _store(t):
    return SnapshotStore(t.spark, f"{shared_folder(t.spark)}/versions-{uuid.uuid4().hex}")


@query("snapshot_commit")
def snapshot_commit(t):
    store, log = _store(t), t("commits")
    store.commit(versions.as_of(log, "node", 20240110), POLICY.main_table, "state of day 10")
    store.commit(versions.as_of(log, "node", 20240120), POLICY.main_table, "state of day 20")
    return store.history().drop("committed_at", "data_path")


@query("rollback", _as_of_sql("20240110"))
def rollback(t):
    store, log = _store(t), t("commits")
    first = store.commit(versions.as_of(log, "node", 20240110), POLICY.main_table, "state of day 10")
    store.commit(versions.as_of(log, "node", 20240120), POLICY.main_table, "state of day 20")
    return store.time_travel(store.rollback(first))
