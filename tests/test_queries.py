"""Every registered query against its SQL, and counts known beforehand."""

import pytest

import __spark_entry__ as entry
from check import compare, tables_db
from csilake.plans import queries as plans
from samples import SF

#: The queries of this library's own domain; those of optional subpackages have tests of their own.
QUERIES = {name: query for name, query in entry.queries().items() if name in plans.QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in plans.QUERIES}


@pytest.fixture(scope="session")
def db():
    return tables_db(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert compare(QUERIES[name](spark, SF), db, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["scenario", "n", "rssi_sum", "rssi_min", "rssi_max", "channels"]


def test_known_counts(spark):
    folder = "/root/testdata/sf0.01"
    summary = {r["scenario"]: (r["n"], r["rssi_sum"]) for r in QUERIES["scenario_summary"](spark, folder).collect()}
    assert summary == {
        "click": (1939, -103733), "error": (1937, -104629), "purchase": (1913, -102696), "signup": (1956, -105859), "view": (1922, -102127)
    }
    assert {r["reason"]: r["n"] for r in QUERIES["reject_reasons"](spark, folder).collect()} == {
        "prefix": 121, "field_count": 102, "bad_number": 110
    }
    assert QUERIES["session_bound"](spark, folder).count() == 1607
    assert QUERIES["failure_streaks"](spark, folder).count() == 150
    assert QUERIES["grid_points"](spark, folder).count() == 10170
    users = QUERIES["users_apply_changes"](spark, folder)
    assert (users.count(), users.where("id >= 1000000").count(), users.agg({"status": "sum"}).collect()[0][0]) == (822, 300, 1016)
