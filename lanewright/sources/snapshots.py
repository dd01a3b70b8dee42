"""Versioned Parquet tables with a manifest: commit, history, time travel and rollback.

One writer per table folder.  Data folders are never changed after a commit; a
rollback is a manifest row that points at older data.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.policy import MAIN_STREAM
from lanewright.sources.tables import _exists

MANIFEST = (
    "seq bigint, snapshot_id string, table_name string, committed_at timestamp, parent_snapshot_id string, "
    "record_count bigint, commit_summary string, status string, data_path string"
)
FIRST_ID = 1000  # fixed value: the first snapshot is snap-1001


@dataclass(frozen=True)
class SnapshotStore:
    spark: SparkSession
    root: str

    @property
    def _log(self) -> str:
        return f"{self.root}/_manifest"

    def history(self, table: str | None = None) -> DataFrame:
        """All snapshots in commit order; the newest of each table is current."""
        if not _exists(self.spark, self._log):
            rows = self.spark.createDataFrame([], MANIFEST)
        else:
            rows = self.spark.read.schema(MANIFEST).parquet(self._log)
        newest = F.max("seq").over(Window.partitionBy("table_name"))
        marked = rows.withColumn("is_current", F.col("seq") == newest)
        return (marked if table is None else marked.filter(F.col("table_name") == table)).orderBy("seq")

    def _find(self, snapshot_id: str):
        found = self.history().filter(F.col("snapshot_id") == snapshot_id).head(1)
        if not found:
            raise KeyError(f"snapshot {snapshot_id} not found")
        return found[0]

    def _append(self, table: str, path: str, records: int, summary: str, status: str) -> str:
        last = self.history().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first()["n"]
        parent = self.history(table).filter("is_current").head(1)
        name = f"snap-{FIRST_ID + last + 1}"
        row = [(last + 1, name, table, parent[0]["snapshot_id"] if parent else None, records, summary, status, path)]
        columns = "seq bigint, snapshot_id string, table_name string, parent_snapshot_id string, record_count bigint, commit_summary string, status string, data_path string"
        stamped = self.spark.createDataFrame(row, columns).withColumn("committed_at", F.current_timestamp())
        stamped.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.mode("append").parquet(self._log)
        return name

    def commit(self, df: DataFrame, table: str, summary: str, status: str = "VALID") -> str:
        """Write the frame as the new current version of the table."""
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        records = self.spark.read.schema(df.schema).parquet(path).count()  # from the file footers
        return self._append(table, path, records, summary, status)

    def time_travel(self, snapshot_id: str) -> DataFrame:
        """The data of the table as of the snapshot."""
        return self.spark.read.parquet(self._find(snapshot_id)["data_path"])

    def as_of(self, table: str, moment: str) -> DataFrame:
        """The data of the last version committed at or before the moment."""
        found = self.history(table).filter(F.col("committed_at") <= F.lit(moment).cast("timestamp")).orderBy(F.col("seq").desc()).head(1)
        if not found:
            raise KeyError(f"{table} has no version at {moment}")
        return self.spark.read.parquet(found[0]["data_path"])

    def rollback(self, snapshot_id: str, table: str = MAIN_STREAM) -> str:
        """Make the data of an older version of the same table current again, as a new snapshot."""
        target = self._find(snapshot_id)
        if target["table_name"] != table:
            raise ValueError(f"{snapshot_id} is a version of {target['table_name']}, not of {table}")
        summary = f"Data Rollback to Snapshot [{snapshot_id}] ({target['commit_summary']})"
        return self._append(table, target["data_path"], target["record_count"], summary, "ROLLED_BACK_RESTORED")
