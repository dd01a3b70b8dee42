from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.functions import features as X
from lanewright.functions import risk, text
from lanewright.functions.numbers import hash52, rnd


def one(df):
    return df.first()[0]


def test_rounding_is_half_up_on_the_decimal_reading(spark):
    df = spark.createDataFrame([(2.675, 2.68), (1.005, 1.01), (-2.675, -2.68), (0.30499999999999999, 0.31), (None, None)], "x double, want double")
    for got, want in df.select(rnd(F.col("x"), 2), "want").collect():
        assert got == want


def test_risk_score_boundaries_and_nulls(spark):
    rows = [("a", 3, 0, 0.0, 0.0), ("b", 2, 0, None, None), ("c", None, 1, 0.0, 0.0), ("d", 0, 0, 101.0, 501.0), ("e", 3, 0, 16.0, 0.0)]
    df = spark.createDataFrame(rows, "warehouse_id string, transport_issue_l1y int, wh_breakdown_l3m int, dist_from_hub double, product_wg_ton double")
    got = {r["warehouse_id"]: (r["risk_score"], r["priority"], r["status"]) for r in risk.with_risk(df).collect()}
    assert got["a"] == (75.0, "HIGH", "Delayed")
    assert got["b"] == (50.0, "HIGH", "Normal")
    assert got["c"] == (20.0, "MEDIUM", "Normal")
    assert got["d"] == (55.0, "HIGH", "Normal")
    assert got["e"][0] == 79.8 and got["e"][1] == "HIGH"
    cuts = spark.createDataFrame([(80.0,), (79.9,), (49.9,), (19.9,)], "s double").select(risk.priority_bucket(F.col("s"))).collect()
    assert [r[0] for r in cuts] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_tiers_and_confidence(spark):
    df = spark.createDataFrame([(0.0,), (0.39,), (0.40,), (0.55,), (0.69,), (0.70,), (1.0,)], "p double")
    got = [tuple(r) for r in df.select(risk.tier(F.col("p")), risk.tier_confidence(F.col("p"))).collect()]
    assert [g[0] for g in got] == [P.TIER_NONE, P.TIER_NONE, P.TIER_LOW, P.TIER_LOW, P.TIER_LOW, P.TIER_FULL, P.TIER_FULL]
    # A probability on an edge skips that edge: 0.40 is 0.3 from its nearest other edge.
    assert [g[1] for g in got] == [1.0, 0.05, 1.0, 0.75, 0.05, 1.0, 1.0]


def test_choices_default_and_half_even_days(spark):
    rows = [("w", 300.0, 1000.0, "Large"), ("x", 0.0, None, None), ("y", 180.0, 10.0, "Tiny")]
    df = spark.createDataFrame(rows, "warehouse_id string, dist_from_hub double, product_wg_ton double, capacity_size string")
    got = {(r["warehouse_id"], r["choice"]): r for r in risk.prescribe_choices(df).collect()}
    assert got["w", "A"]["total_cost"] == 16740.0 and got["w", "A"]["expected_delay_days"] == 2
    assert got["w", "B"]["total_cost"] == 10881.0 and got["w", "C"]["total_cost"] == 6361.2
    assert got["x", "A"]["total_cost"] == 11250.0 and got["x", "C"]["expected_delay_days"] == 9
    assert got["y", "A"]["expected_delay_days"] == 2 and got["y", "A"]["total_cost"] == 6888.83
    assert got["w", "C"]["allocations"] == [250.0, 250.0, 250.0, 150.0, 100.0]


def test_intent_order_and_substrings(spark):
    prompts = ["Please REPAIR it", "use the secondary one", "choice c or rail", "what is the risk", "hello", "cheap and fast"]
    df = spark.createDataFrame([(p, "WH_1", "East", 50.0, 1234567.0) for p in prompts], "prompt string, warehouse_id string, zone string, dist_from_hub double, product_wg_ton double")
    got = text.route_intent(df).collect()
    assert [r["intent"] for r in got] == ["choice_a", "choice_b", "choice_c", "risk", "default", "choice_a"]
    assert "(East Zone, 50.0 km from hub)" in got[4]["reply"] and "1,234,567 tons" in got[4]["reply"]


def test_roi_sentence_for_each_sign(spark):
    columns = "evaluated_outcomes bigint, positive_outcomes bigint, positive_outcome_rate double, total_cost_savings double, avg_delay_improvement double"
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (4, 1, 25.0, 1234.5, 1.5), (4, 1, 33.3, -1000.0, -2.0)], columns)
    nothing, saved, over = [r[0] for r in text.roi_narrative(df).collect()]
    assert nothing == P.ROI_NOTHING
    assert "(25%)" in saved and "$1,234.5 vs" in saved and "1.5 day(s) earlier" in saved
    assert "(33.3%)" in over and "by $1,000 " in over and "2 day(s) over" in over


def test_supplier_bins_are_right_closed_and_iso_week(spark):
    df = spark.createDataFrame([(5.0, 0.1), (5.0, 0.5), (5.0, 1.0), (0.0, 0.0), (None, 1.0)], "supplier_rating double, supplier_ontime_rate double")
    assert [r[0] for r in df.select(X.supplier_risk_bin()).collect()] == ["High", "Medium", "Low", None, None]
    day = spark.sql("select date '2021-01-01' as order_date")
    assert X.calendar_features(day).first()["week"] == 53


def test_hash_is_stable_and_in_range(spark):
    row = spark.createDataFrame([("a",)], "k string").select(hash52("k", F.lit("42"))).first()
    assert row[0] == int(__import__("hashlib").md5(b"a|42").hexdigest()[:13], 16)


def test_search_is_case_blind_and_null_safe(spark):
    df = spark.createDataFrame([("WH_1", None), ("x", "North"), (None, None)], "id string, zone string")
    assert text.search_filter(df, ["id", "zone"], "wh_").count() == 1
    assert text.search_filter(df, ["id", "zone"], "ORT").count() == 1


def test_ordinal_unknown_and_missing_are_minus_one(spark):
    df = spark.createDataFrame([("Low",), ("Odd",), (None,), ("High",)], "supplier_risk string")
    assert [r[0] for r in X.encode_ordinal(df).collect()] == [0, -1, -1, 2]
