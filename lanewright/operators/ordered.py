"""Running totals over a large order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.session import materialize


def running_totals(
    df: DataFrame,
    order: list[Column | str],
    values: list[str],
    groups: list[str] = (),
    slices: int | None = None,
    fold: str = "sum",
) -> DataFrame:
    """Add ``<value>_before``: the sum (or ``fold="max"``) of ``value`` over all earlier rows of the group.

    The rows are range-partitioned on (groups, order), which spreads a group of
    any size over many slices.  The slice number is written out with the rows,
    so it is stable.  One total per (group, slice) is then summed over the
    slices before it, and the exact running sum is finished inside each slice.
    ``order`` must be a total order.  An empty sum is 0, an empty maximum is null.
    """
    if fold == "sum":
        whole, join_up = F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    else:
        whole, join_up = F.max, F.greatest
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = list(groups)
    # A column that the rows have is not carried a second time; with it, branches that read the totals twice ask for the same columns and share the shuffle.
    keys = [c if isinstance(c, str) and c in df.columns else f"_o{i}" for i, c in enumerate(order)]
    made = [(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, keys) if k not in df.columns]
    keyed = df.select("*", *made)
    ranged = keyed.repartitionByRange(slices, *groups, *keys).withColumn("_slice", F.spark_partition_id())
    ranged = materialize(ranged, "running")

    totals = ranged.groupBy(*groups, "_slice").agg(*[whole(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_slice", *[whole(f"_t_{v}").over(earlier).alias(f"_t_{v}") for v in values]
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # Null group keys must meet their own offset, so the join is null-safe.
    left, right = ranged.alias("l"), offsets.alias("r")
    match = F.col("l._slice") == F.col("r._slice")
    for g in groups:
        match = match & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = left.join(right, match).select("l.*", *[f"r._t_{v}" for v in values])
    summed = joined.withColumns(
        {f"{v}_before": join_up(F.col(f"_t_{v}"), whole(v).over(inside)) for v in values}
    )
    return summed.select(*df.columns, *[f"{v}_before" for v in values])
