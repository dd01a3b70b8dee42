"""A page index: rows stored by their place in an order, so that a page costs the same whatever its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators.ordered import running_totals

PLACE = "_place"


def write_page_index(df: DataFrame, order: list[Column | str], folder: str, slices: int | None = None) -> None:
    """Store ``df`` with the place of each row; ``order`` ascends and is total.

    Places are counted in range slices, and the files are sorted by place, so their statistics tell which of them a page needs.
    """
    placed = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], slices=slices)
    placed = placed.withColumn(PLACE, F.col("_one_before").cast("bigint")).drop("_one", "_one_before")
    placed.repartitionByRange(PLACE).sortWithinPartitions(PLACE).write.parquet(folder)


def read_page(spark: SparkSession, folder: str, skip: int = 0, limit: int = 50, most: int = 1000) -> DataFrame:
    """One page: a filter on the place that the scan pushes down, and a sort of its rows only."""
    if skip < 0 or not 1 <= limit <= most:
        raise ValueError(f"skip must be >= 0 and limit between 1 and {most}")
    rows = spark.read.parquet(folder).filter((F.col(PLACE) >= skip) & (F.col(PLACE) < skip + limit))
    return rows.orderBy(PLACE).drop(PLACE)
