"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lanewright")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without that setting; its stages then lie beside its tables, in the warehouse folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage in replicated storage, so the loss of an executor
    later on costs a re-read and not a recomputation, and non-deterministic
    columns such as partition numbers become plain data.  The shuffles of the
    write go with it: nothing else can read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stage = path
    return made


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Statements begun in here remove their shuffle files when they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def release(*stages: DataFrame | None) -> None:
    """Delete stages that ``materialize`` wrote and that nobody reads any more; frames made from them can no longer be read."""
    for stage in stages:
        path = None if stage is None else getattr(stage, "_stage", None)
        if path is not None:
            release_path(stage.sparkSession, path)


def release_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


HOTSPOT_LIMIT = 8000  # fixed value of the JVM


def small_methods(df: DataFrame) -> None:
    """Plans whose generated method HotSpot would not compile (over 8,000 bytes of code) run by compiled projections instead.

    Spark's own default of 65,535 keeps such methods, which then are interpreted.  A smaller setting of the session stays.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.codegen.hugeMethodLimit", "65535")) > HOTSPOT_LIMIT:
        conf.set("spark.sql.codegen.hugeMethodLimit", str(HOTSPOT_LIMIT))
