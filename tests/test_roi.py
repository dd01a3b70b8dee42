import pytest

from lanewright.operators import roi

D = "id long, warehouse_id string, selected_option string, prescribed_cost double, expected_delay_days int, created_at timestamp"
O = "id long, decision_id long, actual_cost double, actual_delay_days int"


@pytest.fixture
def decisions(spark):
    return spark.createDataFrame([(1, "w", "A", 100.0, 5, None), (2, "w", "B", 50.0, 3, None), (3, "w", "A", 10.0, 1, None)], D)


def test_totals_with_orphans_repeats_and_equal_values(spark, decisions):
    outcomes = spark.createDataFrame([(1, 1, 100.0, 5), (2, 1, 120.0, 5), (3, 2, 40.0, 4), (4, 99, 1.0, 1)], O)
    row = roi.roi_totals(decisions, outcomes).first()
    assert row["total_decisions"] == 3 and row["evaluated_outcomes"] == 3 and row["positive_outcomes"] == 1
    assert row["positive_outcome_rate"] == 33.3 and row["total_prescribed_cost"] == 160.0 and row["total_actual_cost"] == 260.0
    assert row["total_cost_savings"] == -100.0 and row["avg_prescribed_delay"] == 3.0 and row["avg_actual_delay"] == 4.7
    assert roi.roi_totals(decisions, outcomes, matched=True).first()["total_cost_savings"] == -10.0


def test_totals_without_outcomes_and_without_decisions(spark, decisions):
    none = spark.createDataFrame([], O)
    row = roi.roi_totals(decisions, none).first()
    assert row["total_cost_savings"] == 0 and row["avg_delay_improvement"] == 0 and row["total_prescribed_cost"] == 160.0
    assert all(v == 0 for v in roi.roi_totals(spark.createDataFrame([], D), none).first())


def test_write_back(spark, decisions):
    new = spark.createDataFrame([(7, "x", "C", 9.0, 5), (3, "y", "C", 8.0, 5)], "request_no long, warehouse_id string, selected_option string, prescribed_cost double, expected_delay_days int")
    both = roi.append_decisions(decisions, new, ["request_no"], now="2024-01-02 00:00:00")
    got = {r["id"]: r["warehouse_id"] for r in both.collect()}
    assert got[4] == "y" and got[5] == "x" and len(got) == 5
    ok, bad = roi.append_outcomes(decisions, spark.createDataFrame([(1, 1, 1.0, 1), (2, 50, 1.0, 1)], O))
    assert [r["decision_id"] for r in ok.collect()] == [1] and [r["decision_id"] for r in bad.collect()] == [50]
    assert [r["id"] for r in roi.pending_outcomes(decisions, ok).collect()] == [2, 3]


def test_form_check(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0), (2, 1, 1.0, 2), (3, None, 1.0, 2)], O)
    assert [r[0] for r in df.select(roi.outcome_valid()).collect()] == [False, True, False]
    assert [r[0] for r in df.select(roi.outcome_valid(allow_zero=True)).collect()] == [True, True, False]
