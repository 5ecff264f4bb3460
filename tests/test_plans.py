"""Plan shapes that must hold on large tables."""

import re

import pytest

from csilake.operators import wire
from csilake.plans.queries import QUERIES
from samples import SF

#: Queries that store tables before they read them.
EAGER = set(
    "ingest_lines append_sessions append_all_or_nothing overwrite_session csv_roundtrip collector_roundtrip ingest_pipeline delete_all schema_growth assign_row_id "
    "view_newest_first view_newest_100 view_card append_numbered view_page allowed_senders other_senders parse_lenient_variant "
    "scenario_summary_by_day users_merge_bucketed collector_newest_first".split()
)
LAZY = [n for n in QUERIES if n not in EAGER and not n.startswith("stream_")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_all_pairs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in text, bad


@pytest.mark.parametrize("name", LAZY)
def test_windows_are_keyed(spark, name):
    """Only the offsets of the row ids, one row per range of the order, are summed without a key."""
    functions = re.findall(r"(\w+)\((\S+?)#[^()]*\) windowspecdefinition\(([^,]*),", plan(QUERIES[name](spark, SF)))
    keyless = {column for _, column, first in functions if " ASC" in first or " DESC" in first}
    assert keyless <= {"_rows"}


def test_line_is_checked_once(spark):
    lines = QUERIES["render_lines"](spark, SF)
    rows, _ = wire.parse_lines(lines)
    text = plan(rows.where("rssi < -40 and channel = 3").groupBy("mac").count())
    assert text.count("split(") <= 1 and len(re.findall(r"Generate explode", text)) == 1


def test_scans_read_what_they_need(spark):
    text = plan(QUERIES["session_bound"](spark, SF))
    for schema in re.findall(r"ReadSchema: (\S+)", text):
        assert "props" not in schema and "value" not in schema
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)" in text


def test_top_rows_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["view_newest_100"](spark, SF))
