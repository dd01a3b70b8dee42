"""Table versions: current snapshot, lineage, time travel on a change log, and the last good version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.operators.ordered import running_totals
from lanewright.policy import MAIN_STREAM
from lanewright.session import materialize


def snapshot_history(manifest: DataFrame, table: str | None = None) -> DataFrame:
    return manifest if table is None else manifest.filter(F.col("table_name") == table)


def current_snapshot(manifest: DataFrame) -> DataFrame:
    """The first row marked current, or the last row when none is."""
    facts = F.struct(*manifest.columns)
    first_marked = F.min_by(F.when(F.col("is_current"), facts), F.when(F.col("is_current"), F.col("seq")))
    return manifest.agg(F.coalesce(first_marked, F.max_by(facts, F.col("seq"))).alias("s")).select("s.*")


def as_of(changes: DataFrame, key: str, seq: int) -> DataFrame:
    """The table as of a commit: the latest change of every key up to it."""
    seen = changes.filter(F.col("commit_seq") <= seq)
    rest = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct("commit_seq", "change_no"))
    return seen.groupBy(key).agg(last.alias("r")).select(key, "r.*")


def snapshot_lineage(manifest: DataFrame) -> DataFrame:
    """Root and depth of every snapshot; one whose parent is null or not in the manifest (expired) is a root.

    Pointers double each round: after k joins a row looks 2^k parents up, so a
    chain of a million commits takes twenty joins and not a million.  Parents that
    form a cycle have no root and are refused.
    """
    known = manifest.select(F.col("snapshot_id").alias("_known"), F.lit(True).alias("_there")).distinct()
    parents = manifest.select("snapshot_id", "parent_snapshot_id").join(known, F.col("parent_snapshot_id") == F.col("_known"), "left")
    rows = parents.select(
        "snapshot_id",
        F.when(F.col("_there"), F.col("parent_snapshot_id")).otherwise(F.col("snapshot_id")).alias("up"),
        F.when(F.col("_there"), 1).otherwise(0).cast("bigint").alias("depth"),
    )
    rows = materialize(rows, "lineage")
    most, moved = rows.count(), True
    while moved:
        above = rows.select(F.col("snapshot_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        rows = rows.join(above, "up").select(
            "snapshot_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("_up") != F.col("up")).alias("_moved")
        )
        # Each round reads the last one twice; writing it keeps the plan from doubling too.
        rows = materialize(rows, "lineage")
        moved = not rows.filter("_moved").isEmpty()
        if moved and rows.agg(F.max("depth")).first()[0] > most:
            raise ValueError("the parents of some snapshots form a cycle")
        rows = rows.drop("_moved")
    return rows.select("snapshot_id", F.col("up").alias("root_snapshot_id"), "depth")


def pre_anomaly_snapshot(manifest: DataFrame, incidents: DataFrame, table: str = MAIN_STREAM) -> DataFrame:
    """For each incident the last valid snapshot committed before it.

    An as-of lookup: both sides are laid out on one time line and the latest
    earlier snapshot is carried along it slice by slice, so no pairs are formed.
    """
    good = manifest.filter((F.col("status") == "VALID") & (F.col("table_name") == table)).select(
        F.col("committed_at").cast("timestamp").alias("at"),
        F.lit(1).alias("kind"),
        F.col("snapshot_id").alias("code"),
        F.struct(F.col("committed_at").cast("timestamp").alias("at"), F.col("snapshot_id").alias("id")).alias("snap"),
    )
    asked = incidents.select(
        F.col("paused_at").alias("at"), F.lit(0).alias("kind"), F.col("incident_code").alias("code"),
        F.lit(None).cast("struct<at:timestamp,id:string>").alias("snap"),
    )
    line = running_totals(good.unionByName(asked), ["at", "kind", "code"], ["snap"], fold="max")
    return line.filter("kind = 0").select(
        F.col("code").alias("incident_code"), F.col("snap_before.id").alias("pre_anomaly_snapshot_id")
    )
