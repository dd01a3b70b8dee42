"""Unions, differences and schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.functions.numbers import flag


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def schema_check(df: DataFrame, required: list[str]) -> DataFrame:
    """The frame itself, or an error that lists every missing column.  Runs no job."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order: absent ones are 0, others are dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in columns])


def dropna_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def fillna_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).fillna(0)


def row_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and removed rows with multiplicity, from one shuffle.

    Both sides carry a signed count, so one aggregate gives both directions.
    """
    columns = before.columns
    signed = before.withColumn("_n", F.lit(-1)).unionByName(after.select(*columns).withColumn("_n", F.lit(1)))
    net = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return net.select(
        *columns,
        F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"),
        F.abs("_n").alias("copies"),
    )


def invalid_value_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of negative values per column, as (column_name, negatives)."""
    counts = df.agg(*[F.coalesce(F.sum(flag(F.col(c) < 0)), F.lit(0)).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("negatives")) for c in columns])
    return counts.select(F.explode(cells).alias("e")).select("e.*")
