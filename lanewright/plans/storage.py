"""Queries that go through files: CSV, JSON reports, seeding and stream routing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lanewright.operators import reports
from lanewright.plans.registry import query
from lanewright.plans.remediation import LATE, POLICY, _event_stream, event_columns, states_sql
from lanewright.session import shared_folder
from lanewright.sources import pages, tables
from lanewright.streaming import breaker_stream as live


def _folder(t, label: str) -> str:
    return f"{shared_folder(t.spark)}/{label}-{uuid.uuid4().hex}"


SUPPLIER_CSV = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
ORDER_CSV = StructType(
    [StructField("OrderID", StringType()), StructField("OrderDate", StringType()), StructField("DistanceKM", DoubleType()), StructField("UnitCost", DoubleType())]
)


@query("scan_csv", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def scan_csv(t):
    path = _folder(t, "suppliers-csv")
    tables.write_csv(t("supplier"), path)
    return tables.scan_csv(t.spark, path, SUPPLIER_CSV)


@query("write_csv", "select OrderID, TransportMode, DistanceKM from {order_lines}")
def write_csv(t):
    path = _folder(t, "orders-csv")
    tables.write_csv(t("order_lines").select("OrderID", "TransportMode", "DistanceKM"), path)
    return tables.scan_csv(t.spark, path, "OrderID string, TransportMode string, DistanceKM double")


@query("scan_csv_dates", "select OrderID, OrderDate, DistanceKM, UnitCost from {order_lines}")
def scan_csv_dates(t):
    path = _folder(t, "dated-csv")
    tables.write_csv(t("order_lines").select("OrderID", "OrderDate", "DistanceKM", "UnitCost"), path)
    return tables.scan_csv_dates(t.spark, path, ORDER_CSV, ["OrderDate", "Order_Date"])


@query("write_json_report", """
select cast(count(*) as bigint) as total_events, count(case when event_type = 'error' then 1 end) as error_events from events""")
def write_json_report(t):
    path = _folder(t, "report-json")
    kpis = reports.error_rate(t("events"), F.col("event_type") == "error").drop("error_rate")
    tables.write_json(kpis, path)
    return t.spark.read.schema("total_events bigint, error_events bigint").json(path)


@query("report_as_json", """
select '{"tier":"' || tier || '","n":' || cast(n as string) || '}' as report from (
  select case when delay_probability < 0.4e0 then 'NO_ACTION_REQUIRED' when delay_probability < 0.7e0 then 'LOW_COST_MITIGATION' else 'FULL_OPTIMIZATION' end as tier, count(*) as n
  from (select (l_partkey * 7919 + l_suppkey) % 1000 / 1e3 as delay_probability from lineitem) p group by 1) x""")
def report_as_json(t):
    from lanewright.functions.risk import tier

    counts = reports.value_counts(t("delay_predictions").select(tier(F.col("delay_probability")).alias("tier")), "tier")
    return tables.as_json(counts)


@query("seed_if_empty", "select warehouse_id, zone, capacity_size from {warehouses}")
def seed_if_empty(t):
    """The second load finds rows and leaves them as they are."""
    path, rows = _folder(t, "seed"), t("warehouses").select("warehouse_id", "zone", "capacity_size")
    tables.seed_if_empty(rows, path)
    tables.seed_if_empty(rows.withColumn("zone", F.lit("none")), path)
    return tables.read_table(t.spark, path)


@query("page_decisions_indexed", "select id, warehouse_id, prescribed_cost from {decisions} order by id desc limit 50 offset 100")
def page_decisions_indexed(t):
    """The page of ``page_decisions`` from a stored index, which later pages would share."""
    folder = _folder(t, "pages")
    pages.write_page_index(t("decisions").select("id", "warehouse_id", "prescribed_cost"), [-F.col("id")], folder)
    return pages.read_page(t.spark, folder, 100, 50, 100)


@query("route_stream", f"""with {states_sql()}
select e.event_id, case when s.state = 'OPEN' then 'warehouses_dlq_stream' else 'warehouses_main_stream' end as landed_in
from events e join states s on s.node = 'node-' || cast(e.user_id as string) and s.batch_id = cast(year(e.ts) * 10000 + month(e.ts) * 100 + day(e.ts) as bigint)""")
def route_stream(t):
    """The events stream written to its main and dead-letter folders by the live breaker, read back with the folder each row is in.

    The feed ends with a closing mark, which a second run of the same query reads: it goes on from the state that the first one left.
    """
    folder, marks = _folder(t, "routed"), _folder(t, "marks")
    closing = t.spark.createDataFrame([("2100-01-01",)], "at string")
    closing.limit(0).write.parquet(marks)
    columns = "event_id bigint, user_id bigint, ts timestamp"
    for last in (False, True):
        if last:
            closing.write.mode("append").parquet(marks)
        events = _event_stream(t).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
        rows = live.timed_events(events, *event_columns())
        rows = rows.unionByName(live.closing_mark(live.read_stream(t.spark, marks, "at string"), F.col("at")))
        routed = live.route_timed_stream(rows, LATE, POLICY)
        read = lambda batch: batch.select(F.from_json("payload", columns).alias("e"), "destination").select("e.event_id", "destination")
        live.route_stream(routed, read, folder, POLICY).awaitTermination()
    out = None
    for name in (POLICY.main_table, POLICY.dlq_table):
        landed = t.spark.read.schema("event_id bigint").parquet(f"{folder}/{name}").select("event_id", F.lit(name).alias("landed_in"))
        out = landed if out is None else out.unionByName(landed)
    return out
