"""Named queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.plans.bindings import base_tables, bind, with_views
from lanewright.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


@dataclass(frozen=True)
class Inputs:
    """The tables and views one query run reads."""

    spark: SparkSession
    sf_dir: str
    known: dict[str, DataFrame] = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        return bind(self.spark, self.sf_dir, name, self.known)

    def stored(self, name: str) -> DataFrame:
        """The view written out once: later joins then plan with its real size, not with that of its source."""
        self.known[name] = materialize(self(name), name)
        return self.known[name]

    def spread(self, name: str, *keys: str) -> DataFrame:
        """A base table dealt out by its keys.  A file is read by one task per row group, and heavy columns worked out there keep that few tasks busy.

        The parts are as many as the shuffle's, rounded up to whole waves of the cores: stages that read what is written from them again and again leave no core idle.
        """
        cores = self.spark.sparkContext.defaultParallelism
        waves = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // cores)
        self.known[name] = self(name).repartition(waves * cores, *keys)
        return self.known[name]

    def stamp(self, *names: str) -> tuple:
        """The session, the folder and the state of the files behind tables or views: what is stored under it is made again when a file changes.

        Files are listed, not read.
        """
        file = F.xxhash64("path", "length", F.col("modificationTime").cast("string"))
        found = [self.spark.sparkContext.applicationId, self.sf_dir]
        for name in sorted(base_tables(names)):
            files = self.spark.read.format("binaryFile").load(f"{self.sf_dir}/{name}.parquet").select(file.alias("file"))
            found.append(files.agg(F.sum(F.col("file").cast("decimal(38,0)"))).first()[0])
        return tuple(found)

    def many(self, *names: str) -> dict[str, DataFrame]:
        return {name: self(name) for name in names}


def query(name: str, check: str | None = None):
    """Register a function of ``Inputs`` under a name, with its check SQL when it has one."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if check is not None:
            CHECKS[name] = with_views(check)
        return build

    return register


def rounded(expr: str, digits: int) -> str:
    """SQL that rounds half up on the decimal value."""
    return f"cast(round(cast({expr} as decimal(28,8)), {digits}) as double)"


def money(expr: str) -> str:
    return f"sum(cast({expr} as decimal(18,4)))"
