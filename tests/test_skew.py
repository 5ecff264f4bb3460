"""Whole queries against their SQL where one device, and one user, hold a third of all rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare, tables_db
from samples import SF

HOT = {
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id)",
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 1 THEN 5 ELSE o_custkey END AS o_custkey)",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    for name in TABLES:
        duckdb.sql(f"COPY (SELECT {HOT.get(name, '*')} FROM '{SF}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize(
    "name",
    "tag_sessions tag_last_start packets_once append_numbered allowed_senders assign_seq assign_row_id session_bound session_packets progress_5s progress_ticks discovery_dedup "
    "failure_streaks users_apply_changes users_change_report seq_gaps interarrival stream_failure_streaks stream_session_timer".split(),
)
def test_query_equals_sql(spark, skewed, name):
    assert compare(entry.queries()[name](spark, skewed), tables_db(skewed), entry.oracle_sql()[name]) is None
