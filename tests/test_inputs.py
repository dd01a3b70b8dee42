"""CSV by header name, lineage of any length, and selections that match nothing."""

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from lanewright.operators import ranking, roi, versions
from lanewright.sources import tables


def _write(folder, *lines):
    folder.mkdir()
    (folder / "part.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = _write(tmp_path / "a", "qty,extra,price", "3,x,2.5", "4,,")
    rows = tables.scan_csv(spark, path, "price double, qty int").collect()
    assert [tuple(r) for r in rows] == [(2.5, 3), (None, 4)]


def test_csv_missing_column_and_bad_cell(spark, tmp_path):
    path = _write(tmp_path / "b", "qty,price", "3,cheap")
    with pytest.raises(ValueError, match="weight"):
        tables.scan_csv(spark, path, "qty int, weight double")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.scan_csv(spark, path, "qty int, price double").collect()


def test_csv_dates_only_where_the_file_has_them(spark, tmp_path):
    path = _write(tmp_path / "c", "OrderDate,id", "2024-03-01,a")
    schema = StructType([StructField(n, StringType()) for n in ("id", "OrderDate", "Order_Date")])
    df = tables.scan_csv_dates(spark, path, schema, ["OrderDate", "Order_Date"])
    assert df.dtypes == [("id", "string"), ("OrderDate", "date")]
    assert str(df.first()["OrderDate"]) == "2024-03-01"


def test_lineage_follows_a_chain_to_its_end(spark):
    chain = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(70)]
    manifest = spark.createDataFrame(chain, "snapshot_id string, parent_snapshot_id string")
    got = {r["snapshot_id"]: (r["root_snapshot_id"], r["depth"]) for r in versions.snapshot_lineage(manifest).collect()}
    assert got == {f"s{i}": ("s0", i) for i in range(70)}


def test_ids_that_match_nothing_are_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    assert ranking.isin_filter(df, spark.createDataFrame([(1,)], "id int"), "id").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        ranking.isin_filter(df, spark.createDataFrame([(2,)], "id int"), "id")


def test_csv_nan_is_null(spark, tmp_path):
    path = _write(tmp_path / "d", "price", "NaN", "1.5")
    assert {r["price"] for r in tables.scan_csv(spark, path, "price double").collect()} == {None, 1.5}


def test_seeded_warehouses_without_ids_are_numbered(spark):
    raw = spark.createDataFrame([("North", 1.0), ("North", 1.0), ("South", 2.0)], "zone string, Demand double")
    got = sorted(r["warehouse_id"] for r in tables.map_columns(raw, tables.WAREHOUSE_SEED).collect())
    assert got == ["WH_100000", "WH_100001", "WH_100002"]


def test_new_decisions_are_only_the_new_rows(spark):
    old = spark.createDataFrame([(7, "w", None)], "id bigint, warehouse_id string, created_at timestamp")
    new = spark.createDataFrame([(2, "b"), (1, "a")], "request_no bigint, warehouse_id string")
    rows = roi.new_decisions(old, new, ["request_no"], now="2024-01-02 00:00:00").collect()
    assert sorted((r["id"], r["warehouse_id"]) for r in rows) == [(8, "a"), (9, "b")]


def test_page_index_reads_what_a_page_holds(spark, tmp_path):
    from lanewright.operators import ranking
    from lanewright.sources import pages

    df = spark.range(0, 5000, 1, 6).selectExpr("(id * 7919) % 5000 as x", "id as y")
    pages.write_page_index(df, ["x"], str(tmp_path / "index"), slices=5)
    for skip, limit in ((0, 10), (1234, 50), (4990, 50), (6000, 5)):
        found = pages.read_page(spark, str(tmp_path / "index"), skip, limit)
        assert found.collect() == ranking.page(df, ["x"], skip, limit).collect()
    assert "GreaterThanOrEqual(_place,1234)" in pages.read_page(spark, str(tmp_path / "index"), 1234, 50)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        pages.read_page(spark, str(tmp_path / "index"), -1)
