"""Decisions, their outcomes and the return on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.numbers import flag, money_sum, rnd_total
from lanewright.operators.ordered import running_totals


def decision_outcome_join(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every outcome with its decision.  Orphans drop out, repeated outcomes stay."""
    d = decisions.select(
        F.col("id").alias("decision_id"), "warehouse_id", "selected_option", "prescribed_cost", "expected_delay_days"
    )
    o = outcomes.select(F.col("id").alias("outcome_id"), "decision_id", "actual_cost", "actual_delay_days")
    return o.join(d, "decision_id")


def positive_outcome() -> Column:
    return (F.col("actual_cost") <= F.col("prescribed_cost")) & (F.col("actual_delay_days") <= F.col("expected_delay_days"))



def roi_totals(decisions: DataFrame, outcomes: DataFrame, matched: bool = False) -> DataFrame:
    """One row of totals.

    By default savings compare all prescribed cost with the evaluated actual
    cost.  ``matched=True`` restricts the prescribed side to evaluated rows.
    Decisions and evaluated outcomes go through one global aggregate as a
    tagged union, so two small partial rows per task are all that is shuffled.
    """
    joined = decision_outcome_join(decisions, outcomes)
    all_rows = decisions.select(
        F.lit(1).alias("is_decision"),
        F.col("prescribed_cost").alias("prescribed"),
        F.col("expected_delay_days").alias("expected"),
        F.lit(None).cast("double").alias("actual_cost"),
        F.lit(None).cast("int").alias("actual_delay_days"),
        F.lit(0).alias("is_positive"),
    )
    evaluated = joined.select(
        F.lit(0).alias("is_decision"),
        F.col("prescribed_cost").alias("prescribed"),
        F.col("expected_delay_days").alias("expected"),
        "actual_cost",
        "actual_delay_days",
        flag(positive_outcome()).alias("is_positive"),
    )
    decision, outcome = F.col("is_decision") == 1, F.col("is_decision") == 0
    base = outcome if matched else decision
    sums = all_rows.unionByName(evaluated).agg(
        F.count_if(decision).alias("n_dec"),
        F.count_if(outcome).alias("n_out"),
        F.sum("is_positive").alias("n_pos"),
        money_sum(F.when(base, F.col("prescribed"))).alias("prescribed"),
        money_sum(F.when(outcome, F.col("actual_cost"))).alias("actual"),
        F.avg(F.when(base, F.col("expected"))).alias("avg_expected"),
        F.avg(F.when(outcome, F.col("actual_delay_days"))).alias("avg_actual"),
    )
    any_out = F.col("n_out") > 0
    zero = F.lit(0.0)
    return sums.select(
        F.col("n_dec").alias("total_decisions"),
        F.col("n_out").alias("evaluated_outcomes"),
        F.coalesce("n_pos", F.lit(0)).alias("positive_outcomes"),
        F.when(any_out, rnd_total(F.col("n_pos") / F.col("n_out") * 100, 1)).otherwise(zero).alias("positive_outcome_rate"),
        F.coalesce(rnd_total(F.col("prescribed"), 2), zero).alias("total_prescribed_cost"),
        F.coalesce(rnd_total(F.col("actual"), 2), zero).alias("total_actual_cost"),
        F.when(any_out, rnd_total(F.col("prescribed") - F.col("actual"), 2)).otherwise(zero).alias("total_cost_savings"),
        F.coalesce(rnd_total(F.col("avg_expected"), 1), zero).alias("avg_prescribed_delay"),
        F.coalesce(rnd_total(F.col("avg_actual"), 1), zero).alias("avg_actual_delay"),
        F.when(any_out, rnd_total(F.col("avg_expected") - F.col("avg_actual"), 1)).otherwise(zero).alias("avg_delay_improvement"),
    )


def roi_by_option(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    joined = decision_outcome_join(decisions, outcomes)
    return (
        joined.groupBy("selected_option")
        .agg(
            F.count("*").alias("count"),
            F.count_if(positive_outcome()).alias("positive"),
            money_sum(F.col("prescribed_cost") - F.col("actual_cost")).alias("saved"),
        )
        .select(
            F.col("selected_option").alias("option"),
            "count",
            "positive",
            rnd_total(F.col("positive") / F.col("count") * 100, 1).alias("success_rate"),
            rnd_total(F.col("saved"), 2).alias("total_savings"),
        )
    )


def recent_outcomes(decisions: DataFrame, outcomes: DataFrame, n: int = 10) -> DataFrame:
    """The n newest evaluated outcomes by id."""
    return (
        decision_outcome_join(decisions, outcomes)
        .orderBy(F.col("outcome_id").desc())
        .limit(n)
        .select(
            "outcome_id",
            "decision_id",
            "warehouse_id",
            "selected_option",
            "prescribed_cost",
            "actual_cost",
            rnd_total(F.col("prescribed_cost") - F.col("actual_cost"), 2).alias("cost_saving"),
            F.col("expected_delay_days").alias("prescribed_delay"),
            F.col("actual_delay_days").alias("actual_delay"),
            (F.col("expected_delay_days") - F.col("actual_delay_days")).alias("delay_improvement"),
            positive_outcome().alias("is_positive"),
        )
    )


def pending_decisions(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Decisions without any outcome."""
    logged = outcomes.select(F.col("decision_id").alias("id"))
    return decisions.join(logged, "id", "left_anti")


def pending_outcomes(decisions: DataFrame, outcomes: DataFrame, n: int = 5) -> DataFrame:
    return pending_decisions(decisions, outcomes).orderBy("id").limit(n)


def pending_count(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    return pending_decisions(decisions, outcomes).agg(F.count("*").alias("pending_outcome_count"))


def new_decisions(existing: DataFrame, new: DataFrame, order: list[str], now=None) -> DataFrame:
    """Only the new decisions, with the next ids in the given order, ready to be appended to the table.

    Positions come from the sliced running total, so the numbering of a large
    batch is not done in one task.  A missing ``created_at`` becomes ``now``.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    created = F.coalesce(F.col("created_at"), stamp) if "created_at" in new.columns else stamp
    numbered = running_totals(new.withColumn("_one", F.lit(1)), order, ["_one"])
    ready = numbered.withColumn("id", top + F.col("_one_before") + 1).withColumn("created_at", created)
    return ready.select(*existing.columns)


def append_decisions(existing: DataFrame, new: DataFrame, order: list[str], now=None) -> DataFrame:
    """The table as it reads after ``new_decisions`` were appended."""
    return existing.unionByName(new_decisions(existing, new, order, now))


def append_outcomes(decisions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split new outcomes into those whose decision exists and those to reject."""
    known = decisions.select(F.col("id").alias("decision_id"))
    return new.join(known, "decision_id", "left_semi"), new.join(known, "decision_id", "left_anti")


def outcome_valid(allow_zero: bool = False) -> Column:
    """A form row is complete: id, cost and delay present and, unless allowed, not zero."""
    ok = F.lit(True)
    for name in ("decision_id", "actual_cost", "actual_delay_days"):
        ok = ok & F.col(name).isNotNull()
        if not allow_zero:
            ok = ok & (F.col(name) != 0)
    return F.coalesce(ok, F.lit(False))


def roi_pct(saving: Column, prescribed: Column) -> Column:
    """Savings in percent of the prescribed cost; 0 when nothing was prescribed."""
    return F.when(prescribed > 0, rnd_total(F.try_divide(saving, prescribed) * 100, 1)).otherwise(F.lit(0.0))


def bar_pct(by_option: DataFrame) -> DataFrame:
    """Bar lengths of the option breakdown, relative to the largest absolute saving."""
    top = by_option.agg(F.greatest(F.max(F.abs("total_savings")), F.lit(1.0)).alias("m")).scalar()
    share = F.least(F.abs(F.col("total_savings")) / top * 100, F.lit(100.0))
    return by_option.withColumn("bar_pct", rnd_total(share, 4))
