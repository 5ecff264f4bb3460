"""As-of tags, packets once, sets as bitmaps, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from csilake.functions import bitmaps
from csilake.operators import asof, sessions, views

DAY = dt.datetime(2024, 1, 1)


def moments(rng, n, span):
    return [None if rng.random() < 0.03 else DAY + dt.timedelta(seconds=rng.randrange(span)) for _ in range(n)]


def by_hand(rows, facts):
    out = []
    for nr, key, at in rows:
        known = [(since, tie, value) for k, since, tie, value in facts if None not in (k, since, key, at) and k == key and since <= at]
        last = max(known, default=(None, None, None))
        out.append((nr, key, at, *last))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,span", [(60, 900), (7, 900), (3600, 90_000), (1, 50)])
def test_last_fact(spark, block, span):
    """One key holds most rows; nulls, instants that several facts share, blocks without facts."""
    rng = random.Random(block)
    keys = lambda n: [rng.choice([1, 1, 1, 1, 2, 3, None]) for _ in range(n)]
    rows = list(zip(range(400), keys(400), moments(rng, 400, span)))
    facts = list(zip(keys(60), moments(rng, 60, span), range(60), [None if i % 7 == 0 else f"v{i}" for i in range(60)]))
    left = spark.createDataFrame(rows, "nr int, key int, at timestamp_ntz").repartition(5)
    right = spark.createDataFrame(facts, "key int, since timestamp_ntz, tie int, value string").repartition(3)
    got = asof.last_before(left, right, ["key"], "at", "since", ["tie"], block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, facts)
    young = asof.last_before(left, right, ["key"], "at", "since", ["tie"], block, within=F.col("since") >= F.col("at") - F.expr("interval 20 seconds"))
    kept = [r if r[3] and (r[2] - r[3]).total_seconds() <= 20 else (*r[:3], None, None, None) for r in by_hand(rows, facts)]
    assert sorted((tuple(r) for r in young.collect()), key=str) == sorted(kept, key=str)


def test_no_facts_no_rows_and_clashes(spark):
    left = spark.createDataFrame([(1, 1, DAY)], "nr int, key int, at timestamp_ntz")
    right = spark.createDataFrame([(1, DAY, 5)], "key int, since timestamp_ntz, value int")
    assert [tuple(r) for r in asof.last_before(left, right.limit(0), ["key"], "at", "since").collect()] == [(1, 1, DAY, None, None)]
    assert asof.last_before(left.limit(0), right, ["key"], "at", "since").collect() == []
    with pytest.raises(ValueError, match="both sides"):
        asof.last_before(left, right.withColumn("nr", F.lit(1)), ["key"], "at", "since")


def test_packets_once_keeps_the_first_and_the_unnumbered(spark):
    rows = [(1, "s", 0), (2, "s", 0), (3, "s", 1), (4, "t", 0), (5, None, 0), (6, None, 0), (7, "s", None), (8, "s", None)]
    packets = spark.createDataFrame(rows, "arrival int, session string, seq int")
    got = sessions.packets_once(packets, ["session"], "seq", "arrival")
    assert got.columns == packets.columns and sorted(r.arrival for r in got.collect()) == [1, 3, 4, 5, 7, 8]


def test_bitmaps_list_what_they_were_made_of(spark):
    rng = random.Random(4)
    values = [*range(-3, 14), 32_767, 32_768, 32_769, 65_536, 65_537, -32_768, -32_769, *(rng.randrange(-200_000, 200_000) for _ in range(200))]
    rows = spark.createDataFrame([(v, i % 5) for i, v in enumerate(values)], "v int, part int")
    parts = rows.groupBy("part", bitmaps.bucket(F.col("v")).alias("b")).agg(bitmaps.of_numbers(F.col("v")).alias("m"))
    whole = parts.groupBy("b").agg(bitmaps.united(F.col("m")).alias("m"))
    assert sorted(x for r in whole.select(bitmaps.numbers(F.col("m"), F.col("b")).alias("x")).collect() for x in r.x) == sorted(set(values))


def test_summary_of_rows_without_channel(spark):
    rows = spark.createDataFrame([("a", -3, 1), ("a", -5, 13), ("a", -4, None), ("b", None, None), (None, -1, 6)], "scenario string, rssi int, channel int")
    assert sorted((tuple(r) for r in views.scenario_summary(rows).collect()), key=str) == sorted(
        [("a", 3, -12, -5, -3, [1, 13]), ("b", 1, None, None, None, []), (None, 1, -1, -1, -1, [6])], key=str
    )
