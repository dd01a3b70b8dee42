"""First match, de-duplication, top-k, paging and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.numbers import hash52
from lanewright.functions.risk import gauge, with_risk


def first_match(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key.

    ``min_by`` combines on the map side, so a key that holds most of the rows
    still sends one row per task, where a ranking window would sort the key
    in a single task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def drop_duplicates_first(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def isin_filter(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the id list; an id list that matches nothing is an error."""
    return nonempty_guard(df.join(ids.select(key), key, "left_semi"), f"selection by {key}")


def nonempty_guard(df: DataFrame, what: str = "input") -> DataFrame:
    """Raise when the frame has no row; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def point_lookup(df: DataFrame, key: str, value, order: list[str]) -> DataFrame:
    """The first row with the key; an empty frame when there is none."""
    return df.filter(F.col(key) == value).orderBy(*order).limit(1)


def priority_queue(warehouses: DataFrame, k: int = 10) -> DataFrame:
    """The k warehouses of highest risk, ties by id."""
    if not 1 <= k <= 50:
        raise ValueError("queue length must be between 1 and 50")
    scored = with_risk(warehouses)
    return scored.orderBy(F.col("risk_score").desc(), "warehouse_id").limit(k).withColumn("gauge", gauge(F.col("risk_score")))


def page(df: DataFrame, order: list[Column | str], skip: int = 0, limit: int = 50, most: int = 1000) -> DataFrame:
    """One page of a total order."""
    if skip < 0 or not 1 <= limit <= most:
        raise ValueError(f"skip must be >= 0 and limit between 1 and {most}")
    return df.orderBy(*order).offset(skip).limit(limit)


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows that does not depend on partitioning."""
    draw = hash52(*keys, F.lit(str(seed)))
    return df.withColumn("_draw", draw).orderBy("_draw", *keys).limit(n).drop("_draw")
