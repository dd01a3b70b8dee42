"""Exact quantiles without gathering a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INFINITE = float("inf")


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], window_rows: int = 20_000
) -> dict[str, dict[float, float | None]]:
    """Linear-interpolated quantiles, exact, as ``{column: {prob: value}}``.

    The driver keeps one bracket (low, high) per column and probability.  While a
    bracket holds more than ``window_rows`` rows, a mergeable sketch proposes
    a tighter one and an exact count confirms that the wanted ranks are inside.
    Sketches are merged in one task, so they are no finer than it takes to fill a window.
    Only rows inside the final brackets are grouped by value and ranked, so
    no task ever sees more than ``window_rows`` distinct values of a bracket.
    """
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = numeric.agg(*[F.count(c).alias(c) for c in columns]).first()
    targets = {}
    for c in columns:
        for p in probs:
            if counts[c]:
                rank = p * (counts[c] - 1)
                targets[(c, p)] = {
                    "rank": rank, "first": math.floor(rank), "last": math.ceil(rank),
                    "low": -INFINITE, "high": INFINITE, "below": 0, "inside": counts[c], "slack": _slack(counts[c], window_rows),
                }
    _narrow(numeric, targets, window_rows)

    answer: dict[str, dict[float, float | None]] = {c: {p: None for p in probs} for c in columns}
    brackets: dict[tuple, int] = {}
    rows = []
    for (c, p), t in targets.items():
        if t["low"] == t["high"]:
            answer[c][p] = t["low"]
            continue
        key = (c, t["low"], t["high"])
        number = brackets.setdefault(key, len(brackets))
        rows.append((number, c, float(p), t["first"] - t["below"], t["last"] - t["below"], t["rank"] - t["first"]))
    if not rows:
        return answer

    inside = [
        F.when(_within(c, low, high), F.struct(F.lit(number).alias("bracket"), F.col(c).alias("value")))
        for (c, low, high), number in brackets.items()
    ]
    values = numeric.select(F.explode(F.array(*inside)).alias("e")).filter("e is not null").select("e.*")
    order = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.groupBy("bracket", "value").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))
    # One literal row per column and probability: the size is fixed by the arguments.
    wanted = df.sparkSession.createDataFrame(rows, "bracket int, name string, p double, first long, last long, part double")
    covers = lambda rank: (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank))
    picked = (
        ranked.join(F.broadcast(wanted), "bracket")
        .filter(covers("first") | covers("last"))
        .groupBy("name", "p", "part")
        .agg(F.min("value").alias("a"), F.max("value").alias("b"))
    )
    for row in picked.collect():  # columns x probabilities rows
        answer[row["name"]][row["p"]] = row["a"] + (row["b"] - row["a"]) * row["part"]
    return answer


def _slack(inside: int, window_rows: int) -> float:
    """Share of the rows left on each side of a wanted rank: a quarter of a window, within shares that a sketch can tell and that leave few values."""
    return max(2e-4, min(0.02, window_rows / (4 * inside)))


def _within(column: str, low: float, high: float):
    known = F.col(column).isNotNull()
    if low > -INFINITE:
        known = known & (F.col(column) >= low)
    if high < INFINITE:
        known = known & (F.col(column) <= high)
    return known


def _narrow(numeric: DataFrame, targets: dict, window_rows: int) -> None:
    """Tighten the brackets in place until each is small or a single value."""
    while True:
        wide = [k for k, t in targets.items() if t["inside"] > window_rows and t["low"] < t["high"] and not t.get("settled")]
        if not wide:
            return
        # Probabilities that still share a bracket share a sketch, which is what a pass costs.
        spans: dict[tuple, list[float]] = {}
        place = {}
        for c, p in wide:
            t = targets[(c, p)]
            middle = (t["first"] - t["below"]) / t["inside"]
            asked = spans.setdefault((c, t["low"], t["high"]), [])
            place[(c, p)] = (c, t["low"], t["high"]), len(asked)
            asked += [min(1.0, max(0.0, middle - t["slack"])), min(1.0, max(0.0, middle + t["slack"]))]
        accuracy = math.ceil(4 / min(targets[k]["slack"] for k in wide))
        guesses = [
            F.percentile_approx(F.when(_within(*bracket), F.col(bracket[0])), F.array(*map(F.lit, asked)), accuracy).alias(f"g{i}")
            for i, (bracket, asked) in enumerate(spans.items())
        ]
        sketched = dict(zip(spans, numeric.agg(*guesses).first()))
        proposal = {key: sketched[bracket][at : at + 2] for key, (bracket, at) in place.items()}
        checks = []
        for i, (c, p) in enumerate(wide):
            low, high = proposal[(c, p)]
            checks.append(F.count(F.when(F.col(c) < low, 1)).alias(f"b{i}"))
            checks.append(F.count(F.when(_within(c, low, high), 1)).alias(f"n{i}"))
        measured = numeric.agg(*checks).first()
        for i, key in enumerate(wide):
            t, (low, high) = targets[key], proposal[key]
            below, inside = measured[f"b{i}"], measured[f"n{i}"]
            if below <= t["first"] and t["last"] < below + inside and inside < t["inside"]:
                t.update(low=low, high=high, below=below, inside=inside, slack=_slack(inside, window_rows))
            elif t["slack"] >= 1.0:
                # The two ranks lie on different heavily repeated values: few distinct values are left.
                t["settled"] = True
            else:
                t["slack"] *= 4
