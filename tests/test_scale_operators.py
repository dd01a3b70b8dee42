"""The sliced running total, exact quantiles and the cheapest-first fill against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewright.operators import allocate, gram, profile, ranking, sets
from lanewright.operators.ordered import running_totals
from lanewright.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_running_totals_match_a_plain_window_with_a_hot_group(spark, slices):
    rnd = random.Random(slices)
    rows = [(i, "hot" if rnd.random() < 0.6 else rnd.choice("abc") if rnd.random() < 0.9 else None, rnd.randrange(5), rnd.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, k int, v long")
    w = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("v_before", F.coalesce(F.sum("v").over(w), F.lit(0)))
    got = running_totals(df, ["k", "id"], ["v"], ["g"], slices=slices)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_running_maximum_carries_the_last_value(spark):
    df = spark.createDataFrame([(i, i if i % 10 == 0 else None) for i in range(100)], "t long, mark long")
    got = {r["t"]: r["mark_before"] for r in running_totals(df, ["t"], ["mark"], slices=7, fold="max").collect()}
    assert got[0] is None and got[1] == 0 and got[10] == 0 and got[11] == 10 and got[99] == 90


@pytest.mark.parametrize("limit", [5, 100, 10_000])
def test_quantiles_are_exact_under_ties_and_narrowing(spark, limit):
    rng = np.random.default_rng(3)
    smooth = rng.lognormal(3, 2, 4000)
    tied = np.where(rng.random(4000) < 0.4, 7.0, rng.integers(0, 50, 4000).astype(float))
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(smooth, tied)], "a double, b double, c double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs, window_rows=limit)
    for p in probs:
        assert got["a"][p] == pytest.approx(np.quantile(smooth, p), rel=1e-12)
        assert got["b"][p] == pytest.approx(np.quantile(tied, p), rel=1e-12)
        assert got["c"][p] is None


def brute_fill(rows, demand):
    left, out = demand, {}
    for cost, ident, cap in sorted(rows):
        out[ident] = min(cap, max(0.0, left))
        left -= out[ident]
    return out


def test_fill_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(str(i), rnd.choice("xy"), float(rnd.randrange(4)), float(rnd.randrange(1, 9)), float(rnd.randrange(0, 6))) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, site string, unit_cost double, capacity double, demand double")
    got = {r["id"]: r["allocated"] for r in allocate.lp_allocation(df, 1e9, "site").collect()}
    for site in "xy":
        mine = [r for r in rows if r[1] == site]
        want = brute_fill([(r[2], r[0], r[3]) for r in mine], sum(r[4] for r in mine))
        assert {k: got[k] for k in want} == want


def test_fill_reports_short_capacity_and_budget(spark):
    columns = "id string, unit_cost double, capacity double, demand double"
    short = spark.createDataFrame([("a", 1.0, 2.0, 5.0)], columns)
    assert [r["feasible"] for r in allocate.lp_allocation(short, 100.0).collect()] == [False]
    assert allocate.budget_scenarios(short).count() == 0
    dear = spark.createDataFrame([("a", 10.0, 9.0, 4.0), ("b", 20.0, 9.0, 8.0)], columns)  # cost 9*10 + 3*20 = 150
    labels = [r["label"] for r in allocate.budget_scenarios(dear, scenarios=(("big", 150.0), ("small", 149.0))).collect()]
    assert labels == ["big"]
    with pytest.raises(Exception, match="negative"):
        allocate.lp_allocation(spark.createDataFrame([("a", -1.0, 2.0, 1.0)], columns), 10.0).collect()


def test_row_diff_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    got = {(r["x"], r["change"], r["copies"]) for r in sets.row_diff(a, b).collect()}
    assert got == {(1, "removed", 1), (2, "removed", 1), (3, "added", 1)}


def test_first_match_and_page_limits(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 2, "b"), (2, 9, "z")], "k int, o int, v string")
    assert {(r["k"], r["o"], r["v"]) for r in ranking.first_match(df, ["k"], ["o"]).collect()} == {(1, 2, "b"), (2, 9, "z")}
    with pytest.raises(ValueError):
        ranking.page(df, ["o"], 0, 1001)
    with pytest.raises(ValueError):
        ranking.nonempty_guard(df.filter("k > 5"))
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        sets.schema_check(df, ["b", "a", "k"])


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = {r[0] for r in ranking.sample_rows(df.repartition(1), ["k"], 50).collect()}
    many = {r[0] for r in ranking.sample_rows(df.repartition(13), ["k"], 50).collect()}
    assert one == many and len(one) == 50


def test_profile_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2, 3, 300).round(3)
    df = spark.createDataFrame([(float(v), None if i % 9 == 0 else "abc"[i % 3]) for i, v in enumerate(x)], "x double, s string")
    got = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    import pandas as pd

    s = pd.Series(x)
    assert got["x"]["skewness"] == pytest.approx(s.skew(), abs=1e-4) and got["x"]["std"] == pytest.approx(s.std(), abs=1e-4)
    assert got["x"]["median"] == pytest.approx(s.median(), abs=1e-4) and got["x"]["unique_count"] == s.nunique()
    assert got["s"]["missing_count"] == 34 and got["s"]["unique_count"] == 3 and got["s"]["mean"] is None


def test_correlations_of_500_columns_with_gaps(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 500)) + rng.normal(size=(80, 1))
    x[:, 1] = x[:, 0] * 3 + 1e9
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2], x[:, 3], x[1:, 4], x[0, 5] = 7.0, np.nan, np.nan, np.inf
    names = [f"c {i}" for i in range(500)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"`{c}` double" for c in names)).repartition(3)
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in gram.correlation_wide(df, names).collect()}
    assert len(got) == 500 * 499 // 2
    for i, j in [(0, 1), (1, 2), (2, 7), (3, 9), (4, 9), (5, 6), *[sorted(rng.choice(np.arange(5, 500), 2, replace=False)) for _ in range(3000)]]:
        pair = x[:, [i, j]][np.isfinite(x[:, [i, j]]).all(axis=1)]
        n, corr = got[names[i], names[j]]
        assert n == len(pair)
        if n < 2 or (pair == pair[0]).all(axis=0).any():
            assert corr is None
        else:
            assert corr == pytest.approx(np.corrcoef(pair.T)[0, 1], abs=1e-6 if 1 in (i, j) else 1e-9)
    none = gram.correlation_wide(df.filter("false"), names[:3]).collect()
    assert [(r["n"], r["corr"]) for r in none] == [(0, None)] * 3 and gram.correlation_wide(df, names[:1]).count() == 0


def test_running_totals_carry_an_order_column_once(spark, monkeypatch):
    from lanewright.operators import ordered

    written = []
    keep = ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, label="stage": written.append(df.columns) or keep(df, label))
    rows = spark.createDataFrame([("a", 2.0, 5), ("b", 1.0, 7), ("c", 2.0, 1)], "id string, cost double, units int")
    found = ordered.running_totals(rows, ["cost", "id"], ["units"])
    assert written == [["id", "cost", "units", "_slice"]] and found.columns == [*rows.columns, "units_before"]
    assert {(r["id"], r["units_before"]) for r in found.collect()} == {("b", 0), ("a", 7), ("c", 12)}
    turned = ordered.running_totals(rows, [-F.col("cost"), "id"], ["units"])
    assert {(r["id"], r["units_before"]) for r in turned.collect()} == {("a", 0), ("c", 5), ("b", 6)}
