import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from lanewright import policy as P
from lanewright.operators import joint, options

SHIP = (
    "shipment_id string, supplier_id long, supplier_country string, destination_country string, warehouse string, product_category string, "
    "units int, shipment_weight double, purchase_order_value double, expected_lead_time double, delay_probability double, expected_delay_days double"
)
BASE = dict(supplier_id=1, supplier_country="A", destination_country="B", warehouse="W1", product_category="Toys", units=10,
            shipment_weight=100.0, purchase_order_value=10000.0, expected_lead_time=5.0, delay_probability=0.8, expected_delay_days=10.0)


def ship(spark, *changes):
    names = [c.split()[0] for c in SHIP.split(", ")]
    rows = [{"shipment_id": f"S{i}"} | BASE | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SHIP)


@pytest.fixture(scope="module")
def refs(spark):
    lanes = [("A", "B", "Air", 2.0, 500, True), ("A", "B", "Rail", 9.0, 900, False), ("A", "B", "Air", 3.0, 1, True)]
    modes = [(m, *v[:3]) for m, v in P.RATE_CARD.items()]
    return {
        "shipping_options": spark.createDataFrame(lanes, "origin_country string, destination_country string, mode string, transit_days double, weekly_capacity_kg long, available boolean"),
        "transport_modes": spark.createDataFrame(modes, "mode string, cost_per_kg_usd double, base_fee_usd double, co2_kg_per_kg_shipped double"),
        "suppliers": spark.createDataFrame([(1, 90001, 0.1, 12), (90001, None, None, 7), (2, None, None, 4)], "supplier_id long, secondary_supplier_id long, secondary_premium_pct double, lead_time_days int"),
        "supplier_capacity": spark.createDataFrame([(90001, "Toys", 10)], "supplier_id long, product_category string, available_capacity_units long"),
        "inventory": spark.createDataFrame([("W1", "Toys", 9, 0.5)], "warehouse_id string, product_category string, usable_safety_stock_units long, holding_cost_per_unit_usd double"),
        "production_schedule": spark.createDataFrame([("P2", "Toys", 5, True, 2.0, 4), ("P1", "Toys", 3, True, 1.0, 3), ("P0", "Toys", 9, False, None, 0)], "production_id string, product_category string, daily_capacity_units long, can_expedite boolean, expedite_cost_per_unit_usd double, max_expedite_days int"),
        "customer_orders": spark.createDataFrame([("S1", "High", 5, 0.02)], "shipment_id string, priority string, sla_max_delay_days int, late_penalty_pct_per_day double"),
    }


def test_every_option(spark, refs):
    rows = options.build_options(ship(spark, {}, {}, {"supplier_id": 2, "product_category": "Food"}), refs).collect()
    got = {(r["shipment_id"], r["option_name"]): r for r in rows}
    air = got["S0", "Air_Freight"]
    assert air["cost_usd"] == 800.0 and air["expected_delay_days"] == 1.2 and air["emission_kg"] == 105.0 and air["metadata"]["transit_days"] == 2.0
    rail = got["S0", "Rail_Freight"]
    assert rail["cost_usd"] is None and not rail["feasible"] and rail["infeasibility_reason"] == "No available Rail lane for A->B."
    assert got["S0", "Sea_Freight"]["expected_delay_days"] == 10.0
    second = got["S0", "Secondary_Supplier"]
    assert second["cost_usd"] == 1000.0 and second["expected_delay_days"] == 2.0 and second["feasible"] and second["resource_key"] == "90001"
    stock = got["S0", "Use_Safety_Stock"]
    assert stock["cost_usd"] == 15.0 and not stock["feasible"] and stock["resource_key"] == "W1|Toys"
    rush = got["S0", "Expedite_Manufacturing"]
    assert rush["resource_key"] == "P1" and rush["cost_usd"] == 10.0 and rush["expected_delay_days"] == 7.0 and not rush["feasible"]
    # 10000 * 0.012 * (10 - 8), and with terms on file 10000 * 0.02 * (10 - 5)
    assert got["S0", "Delay_Launch"]["cost_usd"] == 240.0 and got["S1", "Delay_Launch"]["cost_usd"] == 1000.0
    assert {k[1] for k in got if k[0] == "S2"} == {"Air_Freight", "Rail_Freight", "Sea_Freight", "Delay_Launch"}


@pytest.mark.parametrize("made", [options.cheapest_option, options.effective_cost, options.argmin_option])
def test_options_are_chosen_without_interpreted_functions(spark, refs, made):
    df = made(options.with_options(ship(spark, {}, {"supplier_id": 2}), refs))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_the_first_of_equal_options_stays(spark, refs):
    # No lane, no stock, no line: what is left at zero lateness and zero cost comes in list order.
    rows = ship(spark, {"purchase_order_value": 0.0, "expected_delay_days": 0.0}, {"product_category": "Food", "supplier_id": 2, "supplier_country": "Z"})
    made = options.with_options(rows, refs)
    got = {r["shipment_id"]: (r["option_name"], r["cost_usd"]) for r in options.cheapest_option(made).collect()}
    assert got == {"S0": ("Secondary_Supplier", 0.0), "S1": ("Delay_Launch", 1000.0)}


def test_cheapest_prefers_the_bound_then_falls_back(spark, refs):
    made = options.with_options(ship(spark, {}, {"expected_delay_days": 60.0, "supplier_country": "Z", "supplier_id": 2}), refs)
    got = {r["shipment_id"]: r["option_name"] for r in options.cheapest_option(made).collect()}
    assert got == {"S0": "Air_Freight", "S1": "Delay_Launch"}


def test_hard_sla_removes_slow_options(spark, refs):
    made = options.with_options(ship(spark, {}, {}), refs)
    names = {}
    for r in options.effective_cost(made).collect():
        names.setdefault(r["shipment_id"], {})[r["option_name"]] = r["effective_cost"]
    assert "Delay_Launch" in names["S0"] and "Delay_Launch" not in names["S1"]
    assert names["S0"]["Delay_Launch"] == 240.0 + 10000 * 0.015 * 2  # the lateness counts in the price and again over the SLA
    assert names["S0"]["Air_Freight"] == 808.4


def test_recommendations_by_tier(spark, refs):
    rows = ship(spark, {"delay_probability": 0.1}, {"delay_probability": 0.5}, {"delay_probability": 0.9})
    got = {r["shipment_id"]: r for r in options.recommend_each(options.with_options(rows, refs)).collect()}
    assert got["S0"]["recommended_action"] == "No_Action_Required" and got["S0"]["optimization_status"] == "Not_Required"
    assert got["S1"]["recommended_action"] == "Air_Freight" and got["S1"]["business_impact_usd"] == 200.0
    assert got["S2"]["recommended_action"] == "Delay_Launch" and got["S2"]["optimization_status"] == "Optimal"


def test_one_shipment_takes_no_more_than_there_is(spark, refs):
    high = {"delay_probability": 0.9, "purchase_order_value": 1e9}
    made = options.with_options(ship(spark, high, high), refs)
    offers = {r["shipment_id"]: sorted(r["offers"], key=lambda o: (o["effective_cost"], o["option_pos"])) for r in options.effective_offers(made).collect()}
    free = {r["shipment_id"]: r["recommended_action"] for r in options.recommend_each(made).collect()}
    best, second = offers["S0"][0], offers["S0"][1]
    assert free["S0"] == best["option_name"] and best["resource"] is not None
    kind, key = best["resource"].split(":", 1)
    for capacity, want in ((best["units"], best), (best["units"] - 0.5, second)):
        caps = spark.createDataFrame([(kind, key, capacity)], "resource_type string, resource_key string, capacity double")
        got = {r["shipment_id"]: r["recommended_action"] for r in options.recommend_each(made, 1e12, 1e12, caps).collect()}
        assert got["S0"] == want["option_name"]


def _fake(spark, n, seed):
    """Shipments with random offers on one shared mode, a few stock pools and the free fallback."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        base, out = rnd.uniform(500, 3000), []
        out.append((0, "Air_Freight", round(rnd.uniform(100, 900), 2), 1.0, rnd.uniform(5, 50), "transport_mode", "Air", float(rnd.randint(5, 40))))
        out.append((4, "Use_Safety_Stock", round(rnd.uniform(10, 400), 2), 0.0, 0.0, "inventory", f"W{rnd.randrange(3)}", float(rnd.randint(1, 9))))
        out.append((6, "Delay_Launch", round(base, 2), 3.0, 0.0, None, None, 0.0))
        rows.append((f"S{i}", 1000.0, 0.0, 8.0, "Medium", [(*o[:5], o[5], o[6], o[7], True) for o in out]))
    option = "option_pos:int,option_name:string,cost_usd:double,expected_delay_days:double,emission_kg:double,resource_type:string,resource_key:string,resource_units:double,feasible:boolean"
    return spark.createDataFrame(rows, f"shipment_id string, purchase_order_value double, assign_penalty_pct double, sla_days double, assign_priority string, options array<struct<{option}>>")


def _caps(spark, air, stock):
    return spark.createDataFrame([("transport_mode", "Air", air), *[("inventory", f"W{i}", stock) for i in range(3)]], "resource_type string, resource_key string, capacity double")


def test_joint_choice_without_limits_is_the_argmin(spark):
    made = _fake(spark, 40, 1)
    found = joint.joint_assign(made, _caps(spark, 1e9, 1e9), 1e12, 1e12, price_rounds=3)
    want = {r["shipment_id"]: r["option_name"] for r in options.argmin_option(made).collect()}
    assert {r["shipment_id"]: r["choice"]["option_name"] for r in found.choice.collect()} == want
    assert found.summary.first()["status"] == "Optimal"


def test_joint_choice_keeps_capacities_and_its_bound(spark):
    made = _fake(spark, 8, 7)
    caps = _caps(spark, 60.0, 10.0)
    found = joint.joint_assign(made, caps, 1e12, 1e12, price_rounds=4, improve_rounds=1)
    summary = found.summary.first()
    use = joint.constraint_utilization(found.choice, caps, 1e12, 1e12).collect()
    assert all(r["used"] <= r["capacity"] for r in use)
    offers = {r["shipment_id"]: r["offers"] for r in options.effective_offers(made).collect()}
    best = float("inf")
    limit = {"transport_mode:Air": 60.0} | {f"inventory:W{i}": 10.0 for i in range(3)}
    for combo in itertools.product(*offers.values()):
        used = {}
        for o in combo:
            if o["resource"]:
                used[o["resource"]] = used.get(o["resource"], 0.0) + o["units"]
        if all(v <= limit[k] for k, v in used.items()):
            best = min(best, sum(o["effective_cost"] for o in combo))
    assert summary["lower_bound"] <= best + 1e-6 <= summary["total_cost"] + 1e-5
    assert summary["total_cost"] <= best * 1.25


def test_joint_choice_over_many_proposal_rounds(spark):
    """All shipments bid for one mode and one pool without prices, so the proposals take many rounds to end."""
    made = _fake(spark, 400, 11)
    caps = _caps(spark, 900.0, 60.0)
    found = joint.joint_assign(made, caps, 1e12, 1e12, price_rounds=0, improve_rounds=0)
    picks = [r["choice"] for r in found.choice.collect()]
    assert len(picks) == 400 and all(p is not None for p in picks)
    used = {}
    for p in picks:
        if p["resource"]:
            used[p["resource"]] = used.get(p["resource"], 0.0) + p["units"]
    room = {"transport_mode:Air": 900.0} | {f"inventory:W{i}": 60.0 for i in range(3)}
    assert all(used[k] <= room[k] for k in room) and all(used[k] > 0.8 * room[k] for k in room)
    settled = joint.joint_assign(made, caps, 1e12, 1e12).summary.first()
    assert settled["lower_bound"] <= settled["total_cost"] <= found.summary.first()["total_cost"] and settled["gap"] < 0.08


def test_joint_choice_of_rows_that_repeat_an_id(spark):
    made = _fake(spark, 5, 2)
    found = joint.joint_assign(made.union(made), _caps(spark, 40.0, 5.0), 1e12, 1e12)
    assert found.choice.count() == 10


def test_joint_choice_under_a_binding_carbon_limit(spark):
    made = _fake(spark, 30, 3)
    limit = 60.0  # the cheapest choice emits several times as much
    tight = joint.joint_assign(made, _caps(spark, 1e9, 1e9), 1e12, limit, improve_rounds=1)
    row = tight.summary.first()
    assert row["emitted"] <= limit and row["status"] != "Infeasible" and row["lower_bound"] <= row["total_cost"] + 1e-6
    results = joint.assignment_results(tight.choice)
    assert results.count() == 30 and joint.batch_result(results).first()["shipments"] == 30


def test_rounds_of_the_joint_choice_carry_numbers_only(spark, monkeypatch):
    """Offers and keys stay in the first table: what is written round after round has neither arrays nor strings."""
    seen, write = {}, joint.materialize

    def watched(df, label="stage"):
        seen.setdefault(label, set()).update(t for _, t in df.dtypes)
        return write(df, label)

    monkeypatch.setattr(joint, "materialize", watched)
    found = joint.joint_assign(_fake(spark, 12, 5), _caps(spark, 60.0, 10.0), 1e12, 1e12, price_rounds=1, improve_rounds=1)
    assert found.choice.count() == 12
    rounds = set(seen) - {"offers", "rooms", "choice"}
    assert {"curve", "prices", "ladders", "picks", "wishes"} <= rounds
    assert set().union(*[seen[label] for label in rounds]) <= {"int", "bigint", "double"}


def test_joint_choice_reports_an_impossible_budget(spark):
    row = joint.joint_assign(_fake(spark, 6, 4), _caps(spark, 1e9, 1e9), 1.0, 1e12, improve_rounds=0).summary.first()
    assert row["status"] == "Infeasible" and row["spent"] > 1.0


def test_capacities_that_come_with_the_terms_act_like_a_join_of_the_offers(spark, refs):
    rows = ship(spark, {}, {"units": 9}, {"units": 3, "expected_delay_days": 4.0}, {"supplier_id": 2, "product_category": None}, {"warehouse": None}, {"delay_probability": 0.4})
    types = "resource_type string, resource_key string, capacity double"
    for kept in ([], ["supplier"], ["inventory", "production"], ["transport_mode", "supplier", "inventory", "production"]):
        keys = {"transport_mode": "Air", "supplier": "90001", "inventory": "W1|Toys", "production": "P1"}
        caps = spark.createDataFrame([(k, keys[k], v) for k in kept for v in (1.0, 2.5)], types)
        made = options.with_options(rows, refs, capacities=caps)
        assert set(options.ROOMS.values()) <= set(made.columns)
        want = options.recommend_each(options.with_options(rows, refs), 1e12, 1e12, caps)
        got = options.recommend_each(made, 1e12, 1e12)
        assert got.collect() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        if kept:
            room = {r["shipment_id"]: r for r in made.collect()}["S0"]
            assert all(room[options.ROOMS[{"transport_mode": 0, "supplier": 3, "inventory": 4, "production": 5}[k]]] == 3.5 for k in kept)


def test_the_joint_choice_leaves_only_its_answer_on_disk(spark, monkeypatch):
    """Every round writes its stages; kept until the end they outgrow the offers themselves."""
    written, write = [], joint.materialize

    def watched(df, label="stage"):
        made = write(df, label)
        written.append((label, made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")))
        return made

    monkeypatch.setattr(joint, "materialize", watched)
    found = joint.joint_assign(_fake(spark, 30, 3), _caps(spark, 60.0, 10.0), 1e12, 60.0, price_rounds=2, improve_rounds=2)
    left = {label for label, path in written if os.path.isdir(path)}
    assert {"offers", "work", "ladders", "wishes", "picks"} <= {label for label, _ in written}
    assert "choice" in left and not left & {"offers", "work", "curve", "ladders", "picks", "wishes", "cuts", "spare", "downgraded"}
    assert found.choice.count() == 30


def test_rows_that_were_joined_by_id_are_not_dealt_by_it_again(spark, refs):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    predictions = spark.createDataFrame([("S0", 0.9, 4.0), ("S1", 0.5, 2.0)], "shipment_id string, delay_probability double, expected_delay_days double")
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = options.prediction_join(ship(spark, {}, {}).drop("delay_probability", "expected_delay_days"), predictions)
        plan = options.with_options(rows, refs)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning(shipment_id") == 3  # shipments, predictions and orders, once each


def test_each_shipment_gets_the_optimum_of_its_own_programme(spark, refs):
    """One option exactly, under SLA, budget, carbon and every shared capacity: with one shipment the integer programme is a choice among its offers, all of which are tried here."""
    rng = random.Random(9)
    rows = [{"delay_probability": 0.9, "purchase_order_value": rng.uniform(100, 20_000), "units": rng.randint(1, 14), "shipment_weight": rng.uniform(1, 200),
             "expected_delay_days": round(rng.uniform(0, 20), 1), "supplier_id": rng.choice([1, 2])} for _ in range(40)]
    caps = {"transport_mode:Air": 120.0, "transport_mode:Sea": 150.0, "supplier:90001": 8.0, "inventory:W1|Toys": 5.0, "production:P1": 6.0}
    table = spark.createDataFrame([(*k.split(":"), v) for k, v in caps.items()], "resource_type string, resource_key string, capacity double")
    made = options.with_options(ship(spark, *rows), refs, capacities=table)
    budget, carbon = 900.0, 90.0
    got = {r["shipment_id"]: r for r in options.recommend_each(made, budget, carbon).collect()}
    bound = 0
    for r in made.collect():
        hard, best = r["assign_priority"] in P.HARD_SLA_PRIORITIES, None
        for o in r["options"]:
            late = max(o["expected_delay_days"] - r["sla_days"], 0.0)
            if not o["feasible"] or o["cost_usd"] is None or (hard and late > 0):
                continue
            if o["cost_usd"] > budget or o["emission_kg"] > carbon or o["resource_units"] > caps.get(f"{o['resource_type']}:{o['resource_key']}", float("inf")):
                bound += 1
                continue
            total = o["cost_usd"] + o["emission_kg"] * P.CARBON_PRICE_PER_KG + (0.0 if hard else r["purchase_order_value"] * r["assign_penalty_pct"] * late)
            best = min(best or (float("inf"),), (total, o["option_name"]))
        assert got[r["shipment_id"]]["recommended_action"] == (best[1] if best else "No_Feasible_Option")
    assert bound > 20 and len({g["recommended_action"] for g in got.values()}) > 2
