"""The breaker and its error rates on live streams."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from lanewright.functions.numbers import rnd_total
from lanewright.operators.breaker import CLOSED, HALF_OPEN, OPEN
from lanewright.operators.ranking import first_match
from lanewright.policy import BreakerPolicy
from lanewright.session import shared_folder

log = logging.getLogger("lanewright.streaming")

EVALUATION = (
    "node string, batch_id bigint, total bigint, errors bigint, total_events bigint, error_events bigint, "
    "error_rate double, state string, previous_state string, destination string"
)
#: Totals and status before the open batch, and what has come of that batch so far.
STATE = "total bigint, errors bigint, status string, open_id bigint, open_total bigint, open_errors bigint"
COUNTS = "node string, batch_id bigint, total bigint, errors bigint"


def read_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream, with a declared schema."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: one row per node and batch of each Arrow batch, so a hot node shuffles little."""
    for rows in batches:
        yield rows.groupby(["node", "batch_id"], as_index=False, sort=False)[["total", "errors"]].sum()


def _half_up(rate: float) -> float:
    return int(rate * 100 + 0.5 + 5e-7) / 100


def evaluate_batch_stream(events: DataFrame, node: Column, batch: Column, is_error: Column, policy: BreakerPolicy = BreakerPolicy()) -> DataFrame:
    """Running state per node over a stream of events: a row per node and batch, given again when more of the batch arrives.

    A batch is named by the data (a day, say), not by the micro-batch number, so a
    replay gives the same rows.  The newest batch of a node stays open: what comes of it in a later micro-batch is added to
    it and it is judged anew from the totals before it, so its newest row (see ``latest``) does not depend on how the events were cut into files.  Batches
    of a node must arrive in order; rows of a batch that a newer one has closed count in the open one.
    """
    tagged = events.select(
        node.alias("node"), batch.cast("bigint").alias("batch_id"), F.lit(1).cast("bigint").alias("total"),
        F.when(is_error, 1).otherwise(0).cast("bigint").alias("errors"),
    )
    counted = tagged.mapInPandas(_partial_counts, COUNTS)

    def judged(total: int, errors: int, before: str, n: int, bad: int) -> tuple[int, int, float, str]:
        total, errors = total + n, errors + bad
        rate = _half_up(100.0 * errors / total) if total else 0.0
        if rate > policy.threshold:
            return total, errors, rate, OPEN
        return total, errors, rate, {OPEN: OPEN if bad else HALF_OPEN, HALF_OPEN: CLOSED, CLOSED: CLOSED}[before]

    def advance(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, errors, status, open_id, n, bad = state.get if state.exists else (policy.base_total, policy.base_errors, CLOSED, None, 0, 0)
        sums: dict[int, list[int]] = {}
        for chunk in chunks:
            for batch_id, more, wrong in zip(chunk["batch_id"], chunk["total"], chunk["errors"]):
                seen = sums.setdefault(int(batch_id) if open_id is None else max(int(batch_id), open_id), [0, 0])
                seen[0] += int(more)
                seen[1] += int(wrong)
        out = []
        for batch_id in sorted(sums):
            if open_id is not None and batch_id > open_id:
                total, errors, _, status = judged(total, errors, status, n, bad)
                n = bad = 0
            open_id, n, bad = batch_id, n + sums[batch_id][0], bad + sums[batch_id][1]
            all_events, all_errors, rate, now = judged(total, errors, status, n, bad)
            out.append((key[0], batch_id, n, bad, all_events, all_errors, rate, now, status, policy.dlq_table if now == OPEN else policy.main_table))
        state.update((total, errors, status, open_id, n, bad))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVALUATION.split(", ")])

    return counted.groupBy("node").applyInPandasWithState(advance, EVALUATION, STATE, "update", GroupStateTimeout.NoTimeout)


# --- batches closed by event time -----------------------------------------------
TIMED_COUNTS = "node string, batch_id bigint, total bigint, errors bigint, resets bigint, ends bigint, at timestamp"
TIMED_EVALUATION = EVALUATION + ", reset_epoch bigint"


class Book:
    """What is kept of a node: totals and status of its closed batches, and counts (and events) of the open ones."""

    def __init__(self, policy: BreakerPolicy, kept: dict | None):
        self.policy = policy
        kept = kept or {"total": policy.base_total, "errors": policy.base_errors, "status": CLOSED, "epoch": 0, "open": {}}
        self.total, self.errors, self.status, self.epoch = kept["total"], kept["errors"], kept["status"], kept["epoch"]
        self.open = {int(b): x for b, x in kept["open"].items()}

    def dump(self) -> dict:
        return {"total": self.total, "errors": self.errors, "status": self.status, "epoch": self.epoch, "open": self.open}

    def add(self, batch_id: int, ends: int, n: int, bad: int, reset: bool, payload: str | None = None) -> None:
        entry = self.open.setdefault(batch_id, {"ends": ends, "n": 0, "bad": 0, "reset": False, "held": []})
        entry["n"], entry["bad"], entry["reset"] = entry["n"] + n, entry["bad"] + bad, entry["reset"] or reset
        if payload is not None:
            entry["held"].append(payload)

    def walk(self, closed_by: int | None = None) -> list[tuple]:
        """Evaluations of the open batches in order; with a watermark, only those that it closes, which then leave the book."""
        total, errors, status, epoch, out = self.total, self.errors, self.status, self.epoch, []
        for batch_id in sorted(self.open):
            entry = self.open[batch_id]
            if closed_by is not None and entry["ends"] > closed_by:
                break
            if entry["reset"]:
                total, errors, status, epoch = self.policy.base_total, self.policy.reset_errors, CLOSED, epoch + 1
            before = status
            if entry["n"]:
                total, errors = total + entry["n"], errors + entry["bad"]
                rate = _half_up(100.0 * errors / total) if total else 0.0
                after_open = OPEN if entry["bad"] else HALF_OPEN
                status = OPEN if rate > self.policy.threshold else {OPEN: after_open, HALF_OPEN: CLOSED, CLOSED: CLOSED}[before]
                table = self.policy.dlq_table if status == OPEN else self.policy.main_table
                out.append((batch_id, entry["n"], entry["bad"], total, errors, rate, status, before, table, epoch))
            if closed_by is not None:
                self.total, self.errors, self.status, self.epoch = total, errors, status, epoch
        return out

    def close(self, watermark: int) -> list[tuple[str, str]]:
        """Fold the batches that ended by the watermark into the totals; their events with the table each goes to."""
        held = {b: x["held"] for b, x in self.open.items() if x["ends"] <= watermark}
        released = [(payload, row[8]) for row in self.walk(watermark) for payload in held[row[0]]]
        self.open = {b: x for b, x in self.open.items() if x["ends"] > watermark}
        return released


def timed_marks(marks: DataFrame, node: Column, batch: Column, ends: Column) -> DataFrame:
    """Resets, as rows for ``evaluate_timed_stream``: each restarts its node before the batch is counted.  They do not move the watermark."""
    return marks.select(
        node.alias("node"), batch.cast("bigint").alias("batch_id"), *[F.lit(n).cast("bigint").alias(c) for c, n in (("total", 0), ("errors", 0), ("resets", 1))],
        F.unix_millis(ends).alias("ends"), F.lit(None).cast("timestamp").alias("at"),
    )


def timed_counts(events: DataFrame, node: Column, batch: Column, is_error: Column, ends: Column) -> DataFrame:
    """Events as rows for ``evaluate_timed_stream``, counted per Arrow batch first, so a hot node shuffles little."""
    tagged = events.select(
        node.alias("node"), batch.cast("bigint").alias("batch_id"), F.lit(1).cast("bigint").alias("total"),
        F.when(is_error, 1).otherwise(0).cast("bigint").alias("errors"), F.lit(0).cast("bigint").alias("resets"), F.unix_millis(ends).alias("ends"), ends.alias("at"),
    )

    def combined(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in chunks:
            how = {"total": "sum", "errors": "sum", "resets": "max", "ends": "max", "at": "max"}
            yield rows.groupby(["node", "batch_id"], as_index=False, sort=False).agg(how)

    return tagged.mapInPandas(combined, TIMED_COUNTS)


#: States that hold the books.  A call of a state costs milliseconds whatever it holds, so nodes share one by a hash: calls do not grow with the nodes.
SHELVES = 4096


def _stateful(rows: DataFrame, late: str, policy: BreakerPolicy, schema: str, emit: Callable) -> DataFrame:
    """A book per node, closed by the watermark; ``emit(key, book, first batch touched, watermark)`` gives the rows of a node."""

    def advance(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        books = {node: Book(policy, kept) for node, kept in json.loads(state.get[0])} if state.exists else {}
        touched, watermark = {}, state.getCurrentWatermarkMs()
        for chunk in chunks:
            payloads = chunk["payload"] if "payload" in chunk else [None] * len(chunk)
            for name, batch_id, n, bad, reset, ends, payload in zip(chunk["node"], chunk["batch_id"], chunk["total"], chunk["errors"], chunk["resets"], chunk["ends"], payloads):
                if ends > watermark and (n or reset):
                    node, batch_id = name if isinstance(name, str) else None, int(batch_id)
                    if node not in books:
                        books[node] = Book(policy, None)
                    books[node].add(batch_id, int(ends), int(n), int(bad), bool(reset), payload)
                    touched[node] = min(batch_id, touched.get(node, batch_id))
        out = [row for node, book in books.items() for row in emit((node,), book, touched.get(node), watermark)]
        state.update((json.dumps([(node, book.dump()) for node, book in books.items()]),))
        waiting = [x["ends"] for book in books.values() for x in book.open.values()]
        if waiting:
            state.setTimeoutTimestamp(min(waiting))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    shelved = rows.withWatermark("at", late).withColumn("shelf", F.pmod(F.xxhash64("node"), F.lit(SHELVES)))
    return shelved.groupBy("shelf").applyInPandasWithState(advance, schema, "books string", "append" if schema == ROUTED else "update", GroupStateTimeout.EventTimeTimeout)


def evaluate_timed_stream(rows: DataFrame, late: str, policy: BreakerPolicy = BreakerPolicy()) -> DataFrame:
    """Running state per node from ``timed_counts``, united with ``timed_marks`` if there are resets: a row per node and batch, given again when it changes.

    A batch stays open until the watermark (``late`` behind the end of the newest batch of all nodes) has passed its end, and every row counts in its own batch, in whatever order rows
    arrive until then; all later open batches are judged anew.  The newest row of a batch (see ``latest``) is that of the batch evaluation.  Rows that come after their
    batch was closed are dropped, as the watermark says.
    """

    def emit(key: tuple, book: Book, touched: int | None, watermark: int) -> list[tuple]:
        made = [(key[0], *row) for row in book.walk() if touched is not None and row[0] >= touched]
        book.close(watermark)
        return made

    return _stateful(rows, late, policy, TIMED_EVALUATION, emit)


ROUTED = "payload string, destination string"


def timed_events(events: DataFrame, node: Column, batch: Column, is_error: Column, ends: Column) -> DataFrame:
    """Events as rows for ``route_timed_stream``, with all their columns as JSON."""
    return events.select(
        node.alias("node"), batch.cast("bigint").alias("batch_id"), F.lit(1).cast("bigint").alias("total"), F.when(is_error, 1).otherwise(0).cast("bigint").alias("errors"),
        F.lit(0).cast("bigint").alias("resets"), F.unix_millis(ends).alias("ends"), ends.alias("at"), F.to_json(F.struct("*")).alias("payload"),
    )


def closing_mark(marks: DataFrame, at: Column) -> DataFrame:
    """Rows that say that nothing before ``at`` will come: they only move the watermark, so a feed that has ended is routed to its last event."""
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("batch_id", "total", "errors", "resets", "ends")]
    return marks.select(F.lit("").alias("node"), *zero, at.cast("timestamp").alias("at"), F.lit(None).cast("string").alias("payload"))


def route_timed_stream(rows: DataFrame, late: str, policy: BreakerPolicy = BreakerPolicy()) -> DataFrame:
    """Every event once, as JSON, with the table it goes to: the state after all of its own batch was counted decides.

    An event waits in its node's state until the watermark has closed its batch; nothing but the stream and that state is read.
    """

    def emit(key: tuple, book: Book, touched: int | None, watermark: int) -> list[tuple]:
        return book.close(watermark)

    return _stateful(rows, late, policy, ROUTED, emit)


def windowed_error_rate(events: DataFrame, ts: str, is_error: Column, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Error rate per event-time window; on a stream ``late`` sets the watermark and drops later rows."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark("_at", late)
    window = F.window("_at", length, slide) if slide else F.window("_at", length)
    counts = timed.groupBy(window.alias("w")).agg(F.count("*").alias("total"), F.count_if(is_error).alias("errors"))
    return counts.select(
        F.col("w.start").alias("window_start"), "total", "errors", rnd_total(F.col("errors") * 100 / F.col("total"), 2).alias("error_rate")
    )


def run_to_table(stream: DataFrame, label: str, mode: str = "update") -> DataFrame:
    """Drain a stream into Parquet, one folder per micro-batch, and read all of it back.

    A micro-batch that is replayed overwrites its own folder, so every row is kept
    exactly once.  ``epoch`` is the micro-batch number.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("epoch", LongType())])
    return spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out")


def latest(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest micro-batch for each key, from what ``run_to_table`` reads back."""
    return first_match(parts.withColumn("_newest", -F.col("epoch")), keys, ["_newest"]).drop("_newest", "epoch")


def route_stream(events: DataFrame, decide: Callable[[DataFrame], DataFrame], folder: str, policy: BreakerPolicy = BreakerPolicy()):
    """Write every event of a stream to the main or the dead-letter folder.

    ``decide`` turns a micro-batch into rows with a ``destination``.  Both writes of a
    micro-batch overwrite their own epoch folder, so a replay does not double rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        routed = decide(batch).persist()
        try:
            for table in (policy.main_table, policy.dlq_table):
                routed.filter(F.col("destination") == table).drop("destination").write.mode("overwrite").parquet(f"{folder}/{table}/epoch={epoch}")
        finally:
            routed.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_log").trigger(availableNow=True).start()


def state_change_feed(evaluations: DataFrame, listeners: list[Callable[[DataFrame, int], None]], log_folder: str):
    """Call every listener with the state changes of each micro-batch; a failing listener does not stop the stream."""

    def tell(batch: DataFrame, epoch: int) -> None:
        changes = batch.filter("state <> previous_state").persist()
        try:
            for listener in listeners:
                try:
                    listener(changes, epoch)
                except Exception:
                    log.exception("listener failed in micro-batch %s", epoch)
        finally:
            changes.unpersist()

    return evaluations.writeStream.outputMode("update").foreachBatch(tell).option("checkpointLocation", log_folder).trigger(availableNow=True).start()
