"""Cheapest-first allocation: the optimum of the single-demand linear programme.

For costs >= 0 the minimum of sum(c*x) with 0 <= x <= capacity and sum(x) >= demand
fills the cheapest capacity first, so a running sum of capacity replaces a solver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions.numbers import money_sum, rnd_total
from lanewright.operators.ordered import running_totals

UNITS = "decimal(28,6)"  # totals of quantities are exact, so they do not depend on the order of the rows


def fill_cheapest(df: DataFrame, group: str | None = None) -> DataFrame:
    """Adds ``allocated`` per row and the group's ``total_cost`` and ``short`` (demand beyond capacity)."""
    groups = [group] if group else []
    sums = df.groupBy(*groups).agg(
        F.sum(F.col("demand").cast(UNITS)).alias("demand_total"), F.sum(F.col("capacity").cast(UNITS)).alias("capacity_total"),
        F.min("unit_cost").alias("least_cost"),
    )
    filled = running_totals(df.withColumn("_units", F.col("capacity").cast(UNITS)), ["unit_cost", "id"], ["_units"], groups)
    filled = filled.withColumnRenamed("_units_before", "capacity_before").drop("_units")
    filled = _attach(filled, sums, groups, ["demand_total", "capacity_total", "least_cost"])
    need = F.greatest(F.lit(0.0), (F.col("demand_total") - F.col("capacity_before")).cast("double"))
    checked = F.when(F.col("least_cost") < 0, F.raise_error(F.lit("unit costs must not be negative"))).otherwise(need)
    return filled.withColumn("allocated", F.least(F.col("capacity"), checked)).withColumn(
        "short", F.greatest(F.lit(0.0), (F.col("demand_total") - F.col("capacity_total")).cast("double"))
    )


def allocation_cost(filled: DataFrame, group: str | None = None) -> DataFrame:
    groups = [group] if group else []
    return filled.groupBy(*groups).agg(
        rnd_total(money_sum(F.col("unit_cost") * F.col("allocated")), 2).alias("total_cost"), F.max("short").alias("short")
    )


def _attach(df: DataFrame, sums: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    if groups:
        return df.join(sums, groups)
    one = sums.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("_s", one).select("*", *[F.col(f"_s.{n}").alias(n) for n in names]).drop("_s")


def lp_allocation(df: DataFrame, budget: float, group: str | None = None) -> DataFrame:
    """Optimal quantities and whether they meet demand within the budget."""
    groups = [group] if group else []
    filled = fill_cheapest(df, group)
    costs = allocation_cost(filled, group).withColumnRenamed("short", "_short")
    joined = _attach(filled, costs, groups, ["total_cost", "_short"])
    feasible = (F.col("_short") == 0) & (F.col("total_cost") <= budget)
    return joined.select(*groups, "id", "unit_cost", "allocated", feasible.alias("feasible"))


def budget_scenarios(df: DataFrame, group: str | None = None, scenarios=P.LP_SCENARIOS) -> DataFrame:
    """Totals of the scenarios that are feasible; a scenario out of reach has no row.

    The cheapest fill does not depend on the budget, so it is computed once and
    the scenarios are an explode of a constant list on the totals.
    """
    groups = [group] if group else []
    filled = fill_cheapest(df, group)
    totals = filled.groupBy(*groups).agg(
        rnd_total(money_sum(F.col("unit_cost") * F.col("allocated")), 2).alias("total_cost"),
        F.max("short").alias("short"),
        F.sum("allocated").alias("allocated"),
        F.count_if(F.col("allocated") > 0).alias("rows_used"),
    )
    options = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(b).alias("budget")) for n, b in scenarios])
    affordable = F.filter(options, lambda s: (F.col("short") == 0) & (F.col("total_cost") <= s["budget"]))
    return totals.select(*groups, F.explode(affordable).alias("s"), "allocated", "rows_used", "total_cost").select(
        *groups, "s.label", "s.budget", "allocated", "rows_used", "total_cost"
    )
