"""Every registered query with check SQL against DuckDB on the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from tests.check_oracle import compare, oracle_connection

SF = "/root/testdata/sf0.001"
CHECKS = entry_module.oracle_sql()
QUERIES = entry_module.queries()
#: The table is too short at this scale for the page that is read.
EMPTY_HERE = {"page_warehouses"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("key", sorted(CHECKS))
def test_query_matches_its_check(spark, con, key):
    status, n, _, note = compare(spark, con, SF, key, QUERIES[key], CHECKS[key])
    assert status == ("EMPTY" if key in EMPTY_HERE else "ok"), note or status


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 10
    assert set(CHECKS) <= set(QUERIES)
