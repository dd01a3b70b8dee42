import random

import pytest
from pyspark.sql import functions as F

from lanewright.operators import breaker, breaker_slices, sets, versions
from lanewright.policy import BreakerPolicy
from lanewright.session import shared_folder
from lanewright.sources.snapshots import SnapshotStore
from lanewright.streaming import breaker_stream as live

COUNTS = "node string, batch_id long, total long, errors long"


def walk(batches, policy, resets=()):
    """The breaker one batch at a time."""
    total, errors, state, out = policy.base_total, policy.base_errors, "CLOSED", []
    for batch_id, n, bad in batches:
        if batch_id in resets:
            total, errors, state = policy.base_total, policy.reset_errors, "CLOSED"
        total, errors = total + max(n, 0), errors + max(bad, 0)
        rate = int(10000 * errors / total + 0.5 + 1e-9) / 100 if total else 0.0
        if rate > policy.threshold:
            state = "OPEN"
        elif state == "OPEN" and bad == 0:
            state = "HALF_OPEN"
        elif state == "HALF_OPEN":
            state = "CLOSED"
        out.append((batch_id, state))
    return out


def test_known_case_trips_and_an_exact_rate_does_not(spark):
    df = spark.createDataFrame([("n", 1, 200, 24), ("m", 1, 1000, 35), ("z", 1, 0, 0)], COUNTS)
    got = {r["node"]: (r["error_rate"], r["state"]) for r in breaker.breaker_states(df).collect()}
    assert got == {"n": (2.42, "OPEN"), "m": (2.0, "CLOSED"), "z": (0.5, "CLOSED")}


@pytest.mark.parametrize("with_resets", [False, True])
def test_closed_form_equals_the_walk(spark, with_resets):
    rnd = random.Random(11)
    policy = BreakerPolicy(threshold=5.0, base_total=50, base_errors=2, reset_errors=1)
    rows, resets, want = [], [], {}
    for node in range(60):
        batches = [(b, rnd.randint(-3, 60), rnd.choice([0, 0, 0, -1, 1, 2, 9])) for b in range(25)]
        mine = {b for b in range(25) if with_resets and rnd.random() < 0.1}
        rows += [(f"n{node}", *x) for x in batches]
        resets += [(f"n{node}", b) for b in mine]
        want[f"n{node}"] = walk(batches, policy, mine)
    marks = spark.createDataFrame(resets, "node string, batch_id long") if with_resets else None
    got = breaker.breaker_states(spark.createDataFrame(rows, COUNTS), policy, marks).select("node", "batch_id", "state").collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(n, b, s) for n, steps in want.items() for b, s in steps}


@pytest.mark.parametrize("with_resets", [False, True])
def test_slices_of_one_hot_node_equal_the_walk(spark, with_resets):
    rnd = random.Random(21)
    policy = BreakerPolicy(threshold=5.0, base_total=50, base_errors=2, reset_errors=1)
    hot = [(b, rnd.randint(-3, 60), rnd.choice([0, 0, 0, -1, 1, 2, 9])) for b in range(2000)]
    cold = [(b, 10, 0) for b in range(5)]
    resets = {b for b in range(2000) if with_resets and rnd.random() < 0.02}
    counts = spark.createDataFrame([("hot", *x) for x in hot] + [("cold", *x) for x in cold], COUNTS)
    marks = spark.createDataFrame([("hot", b) for b in resets], "node string, batch_id long") if with_resets else None
    made = breaker_slices.sliced_states(counts, policy, marks, slices=8)
    got = {(r["node"], r["batch_id"], r["state"]) for r in made.select("node", "batch_id", "state").collect()}
    assert got == {("hot", *x) for x in walk(hot, policy, resets)} | {("cold", *x) for x in walk(cold, policy)}
    columns = ["node", "batch_id", "epoch", "total_events", "error_events", "error_rate", "state"]
    assert sorted(map(tuple, made.select(columns).collect())) == sorted(map(tuple, breaker.breaker_states(counts, policy, marks).select(columns).collect()))


def test_routing_is_a_partition_and_incidents_close(spark):
    events = spark.createDataFrame([(i, "n", i // 100, i < 130) for i in range(300)], "id long, node string, batch_id long, bad boolean")
    policy = BreakerPolicy(threshold=10.0, base_total=0, base_errors=0)
    counts = breaker.batch_counts(events, "node", "batch_id", F.col("bad")).withColumn("last_ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    states = breaker.breaker_states(counts, policy)
    main, dlq = breaker.split_routes(breaker.route_records(events, states, policy), policy)
    assert main.count() + dlq.count() == 300 and main.join(dlq, "id").count() == 0
    assert {r["batch_id"] for r in dlq.select("batch_id").distinct().collect()} == {0, 1, 2}
    opened = breaker.open_incidents(states, policy)
    assert opened.count() == 3 and breaker.open_incidents(states, policy, only_changes=True).count() == 1
    closed = breaker.resolve_incidents(opened, "2024-01-01 00:01:30").collect()
    assert {(r["status"], r["duration_seconds"]) for r in closed} == {("RESOLVED", 90)}
    assert breaker.rollback_incidents(opened, "2024-01-01 00:01:30").first()["status"] == "ROLLED_BACK"
    again = breaker.incident_history(breaker.resolve_incidents(opened, "2024-01-01 00:00:00"), "2024-01-02 00:00:00").first()
    assert again["duration_seconds"] == 180
    assert breaker.breaker_status(states, policy).first()["node_status"] == "RED_ALERT"


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, f"n{rnd.randrange(4)}", day, rnd.random() < (0.4 if day in (2, 5) else 0.01)) for day in range(8) for i in range(150)]
    schema = "id long, node string, day long, bad boolean"
    df = spark.createDataFrame(rows, schema)
    for part in range(16):  # two files per day, in order: no batch arrives whole
        df.filter((F.col("day") == part // 2) & (F.col("id") % 2 == part % 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    policy = BreakerPolicy(threshold=8.0, base_total=10, base_errors=0)
    stream = live.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    evaluated = live.evaluate_batch_stream(stream, F.col("node"), F.col("day"), F.col("bad"), policy)
    parts = live.run_to_table(evaluated, "test")
    assert parts.count() > parts.select("node", "batch_id").distinct().count()
    got = live.latest(parts, ["node", "batch_id"]).select("node", "batch_id", "error_rate", "state")
    counts = breaker.batch_counts(df, "node", "day", F.col("bad"))
    want = breaker.breaker_states(counts, policy).select("node", "batch_id", "error_rate", "state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seen = []

    def broken(changes, epoch):
        raise ValueError("listener is down")

    def keep(changes, epoch):
        seen.extend((r["node"], r["batch_id"], r["state"]) for r in changes.collect())

    stream = live.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=8)
    evaluated = live.evaluate_batch_stream(stream, F.col("node"), F.col("day"), F.col("bad"), policy)
    live.state_change_feed(evaluated, [broken, keep], str(tmp_path / "log")).awaitTermination()
    changes = breaker.state_changes(breaker.breaker_states(counts, policy)).select("node", "batch_id", "state").collect()
    assert sorted(seen) == sorted(map(tuple, changes))


def day_rows(rnd, days=6, per_day=60):
    rows = [(d * per_day + i, f"n{rnd.randrange(3)}", d, rnd.random() < (0.5 if d in (1, 4) else 0.02)) for d in range(days) for i in range(per_day)]
    return [(i, n, d, bad, f"2024-01-{d + 1:02d} {(i * 7) % 24:02d}:00:00") for i, n, d, bad in rows]


def timed_columns():
    return F.col("node"), F.col("day"), F.col("bad"), F.date_trunc("day", F.col("at").cast("timestamp")) + F.expr("interval 1 day")


@pytest.mark.parametrize("with_resets", [False, True])
def test_timed_stream_in_any_order_equals_batch(spark, tmp_path, with_resets):
    rnd = random.Random(5)
    rows, schema = day_rows(rnd), "id long, node string, day long, bad boolean, at string"
    rnd.shuffle(rows)
    for part in range(4):  # every file has rows of all days
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    policy = BreakerPolicy(threshold=8.0, base_total=10, base_errors=0, reset_errors=1)
    stream = live.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    counted = live.timed_counts(stream, *timed_columns())
    marks = spark.createDataFrame([("n0", 2), ("n1", 5), ("n2", 2)], "node string, batch_id long")
    if with_resets:
        marks.coalesce(1).write.parquet(str(tmp_path / "resets"))
        resets = live.read_stream(spark, str(tmp_path / "resets"), "node string, batch_id long")
        ends = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-02 00:00:00")) + F.col("batch_id") * 86400)
        counted = counted.unionByName(live.timed_marks(resets, F.col("node"), F.col("batch_id"), ends))
    got = live.latest(live.run_to_table(live.evaluate_timed_stream(counted, "10 days", policy), "timed"), ["node", "batch_id"])
    counts = breaker.batch_counts(spark.createDataFrame(rows, schema), "node", "day", F.col("bad"))
    want = breaker.breaker_states(counts, policy, marks if with_resets else None).select("node", "batch_id", "error_rate", "state", "epoch")
    assert sorted(map(tuple, got.select("node", "batch_id", "error_rate", "state", "reset_epoch").collect())) == sorted(map(tuple, want.collect()))


def test_nodes_that_share_a_state_keep_their_own_books(spark, tmp_path, monkeypatch):
    """Calls of a state do not grow with the nodes: 41 nodes lie in two states, and each gives the rows of the batch evaluation."""
    monkeypatch.setattr(live, "SHELVES", 2)
    rnd = random.Random(13)
    schema = "id long, node string, day long, bad boolean, at string"
    rows = [(i, f"n{i % 41}", d, bad, at) for i, _, d, bad, at in day_rows(rnd, per_day=200)]
    for part in range(6):  # a day a file: batches are closed while others come in
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    policy = BreakerPolicy(threshold=8.0, base_total=10, base_errors=0)
    stream = live.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    evaluated = live.evaluate_timed_stream(live.timed_counts(stream, *timed_columns()), "1 day", policy)
    got = live.latest(live.run_to_table(evaluated, "shelves"), ["node", "batch_id"])
    counts = breaker.batch_counts(spark.createDataFrame(rows, schema), "node", "day", F.col("bad"))
    want = breaker.breaker_states(counts, policy).select("node", "batch_id", "error_rate", "state")
    assert sorted(map(tuple, got.select("node", "batch_id", "error_rate", "state").collect())) == sorted(map(tuple, want.collect()))
    assert "shelf" in evaluated._jdf.queryExecution().analyzed().toString()


def test_live_routes_wait_for_their_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows, schema = day_rows(rnd), "id long, node string, day long, bad boolean, at string"
    policy = BreakerPolicy(threshold=8.0, base_total=10, base_errors=0)
    closing = spark.createDataFrame([("2100-01-01",)], "at string")
    closing.limit(0).write.parquet(str(tmp_path / "marks"))
    half = len(rows) // 12
    for last in (False, True):
        for part in range(0 if not last else 6, 6 if not last else 12):  # two files a day, the later rows of a day first
            piece = rows[part * half : (part + 1) * half] if part % 2 else list(reversed(rows[part * half : (part + 1) * half]))
            spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if last:
            closing.write.mode("append").parquet(str(tmp_path / "marks"))
        events = live.timed_events(live.read_stream(spark, str(tmp_path / "in"), schema), *timed_columns())
        events = events.unionByName(live.closing_mark(live.read_stream(spark, str(tmp_path / "marks"), "at string"), F.col("at")))
        read = lambda batch: batch.select(F.get_json_object("payload", "$.id").cast("long").alias("id"), "destination")
        live.route_stream(live.route_timed_stream(events, "1 day", policy), read, str(tmp_path / "out"), policy).awaitTermination()
    got = {(r["id"], name) for name in (policy.main_table, policy.dlq_table) for r in spark.read.schema("id long").parquet(str(tmp_path / "out" / name)).collect()}
    df = spark.createDataFrame(rows, schema).withColumn("batch_id", F.col("day"))
    states = breaker.breaker_states(breaker.batch_counts(df, "node", "day", F.col("bad")), policy)
    want = {(r["id"], r["destination"]) for r in breaker.route_records(df, states, policy).collect()}
    assert got == want and len({name for _, name in got}) == 2


def test_versions_time_travel_and_rollback(spark):
    store = SnapshotStore(spark, f"{shared_folder(spark)}/store-{random.random()}")
    first, second = spark.range(5).toDF("x"), spark.range(3, 9).toDF("x")
    a = store.commit(first, "warehouses_main_stream", "first")
    q = store.commit(second, "warehouses_dlq_stream", "bad rows", "QUARANTINED_ANOMALY")
    b = store.commit(second, "warehouses_main_stream", "second")
    assert (a, q, b) == ("snap-1001", "snap-1002", "snap-1003")
    back = store.rollback(a)
    assert sorted(r[0] for r in store.time_travel(back).collect()) == list(range(5))
    rows = {r["snapshot_id"]: r for r in store.history().collect()}
    assert rows[back]["parent_snapshot_id"] == b and rows[back]["is_current"] and not rows[b]["is_current"] and rows[q]["is_current"]
    assert rows[back]["status"] == "ROLLED_BACK_RESTORED" and rows[back]["record_count"] == 5
    assert store.history("warehouses_main_stream").count() == 3
    diff = sets.row_diff(store.time_travel(a), store.time_travel(b))
    assert {(r["x"], r["change"]) for r in diff.collect()} == {(0, "removed"), (1, "removed"), (2, "removed"), (5, "added"), (6, "added"), (7, "added"), (8, "added")}
    with pytest.raises(KeyError):
        store.time_travel("snap-9")
    with pytest.raises(ValueError):
        store.rollback(q)


def test_lineage_and_current(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i % 7 else None, i, i == 20) for i in range(40)]
    manifest = spark.createDataFrame(rows, "snapshot_id string, parent_snapshot_id string, seq long, is_current boolean")
    got = {r["snapshot_id"]: (r["root_snapshot_id"], r["depth"]) for r in versions.snapshot_lineage(manifest).collect()}
    assert got["s6"] == ("s0", 6) and got["s7"] == ("s7", 0) and got["s39"] == ("s35", 4) and len(got) == 40
    assert versions.current_snapshot(manifest).first()["snapshot_id"] == "s20"
    assert versions.current_snapshot(manifest.withColumn("is_current", F.lit(False))).first()["snapshot_id"] == "s39"


def test_lineage_with_expired_parents_and_cycles(spark):
    schema = "snapshot_id string, parent_snapshot_id string"
    made = versions.snapshot_lineage(spark.createDataFrame([("s3", "s2"), ("s2", "s1"), ("r", None), ("q", "r")], schema)).collect()
    assert {tuple(r) for r in made} == {("s3", "s2", 1), ("s2", "s2", 0), ("r", "r", 0), ("q", "r", 1)}
    with pytest.raises(ValueError):
        versions.snapshot_lineage(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], schema))


def test_last_good_snapshot_is_strictly_earlier(spark):
    manifest = spark.createDataFrame(
        [("a", "warehouses_main_stream", "VALID", "2024-01-01 00:00:00"), ("b", "warehouses_main_stream", "VALID", "2024-01-02 00:00:00"), ("c", "warehouses_dlq_stream", "VALID", "2024-01-02 12:00:00")],
        "snapshot_id string, table_name string, status string, committed_at string",
    ).withColumn("committed_at", F.col("committed_at").cast("timestamp"))
    incidents = spark.createDataFrame([("i", "2024-01-02 00:00:00"), ("j", "2024-01-03 00:00:00"), ("k", "2023-01-01 00:00:00")], "incident_code string, paused_at string")
    got = versions.pre_anomaly_snapshot(manifest, incidents.withColumn("paused_at", F.col("paused_at").cast("timestamp"))).collect()
    assert {r[0]: r[1] for r in got} == {"i": "a", "j": "b", "k": None}
