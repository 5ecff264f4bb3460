"""Blocked operators against plain Python, with a key that holds a third of all rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from csilake.operators import sessions
from csilake.operators.control import discovery_dedup
from csilake.operators.ordered import arrival_block, previous_value, row_numbers, running_total
from csilake.operators.repeats import collapse_repeats
from csilake.operators.streaks import failure_streaks

T0 = datetime(2024, 1, 1)


def skewed(n=600, seed=3):
    rng = random.Random(seed)
    return [(i, 0 if rng.random() < 1 / 3 else rng.randrange(1, 20), rng.randrange(0, 5)) for i in range(n)]


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_running_total_row_number_previous(spark, block):
    data = skewed()
    df = spark.createDataFrame(data, "arrival bigint, k bigint, v int")
    cut = arrival_block("arrival", block)
    df = running_total(df, ["k"], ["arrival"], cut, F.col("v"), "total")
    df = row_numbers(df, ["k"], ["arrival"], cut, "nr")
    df = previous_value(df, ["k"], ["arrival"], cut, "v", "before")
    total, count, last = defaultdict(int), defaultdict(int), {}
    expected = []
    for arrival, k, v in data:
        total[k] += v
        expected.append((arrival, k, v, total[k], count[k], last.get(k)))
        count[k] += 1
        last[k] = v
    assert sorted(map(tuple, df.collect())) == expected


@pytest.mark.parametrize("rows_per_block", [3, 1000])
def test_assign_seq_and_row_id(spark, rows_per_block):
    data = [(a, k, (T0 + timedelta(days=a // 250)).date()) for a, k, _ in skewed()]
    df = spark.createDataFrame(data, "arrival bigint, k bigint, d date")
    seq = defaultdict(int)
    numbered = {}
    for arrival, k, d in data:
        numbered[arrival] = seq[k, d]
        seq[k, d] += 1
    found = sessions.assign_seq(df, ["k", "d"], "arrival", rows_per_block)
    assert {r["arrival"]: r["seq"] for r in found.collect()} == numbered

    order = sorted(data, key=lambda r: (r[2], r[1], r[0]))
    ids = {r[0]: 101 + i for i, r in enumerate(order)}
    tags = df.select("d", "k").distinct().withColumn("tag", F.concat_ws("-", "k", "d"))
    found = sessions.assign_row_id(df, "d", "k", "arrival", 101, tags).collect()
    assert {r["arrival"]: r["id"] for r in found} == ids
    assert all(r["tag"] == f"{r['k']}-{r['d']}" for r in found)


@pytest.mark.parametrize("block_seconds", [10, 86400])
def test_collapse_repeats(spark, block_seconds):
    rng = random.Random(5)
    data = []
    for k in range(6):
        t = 0
        for _ in range(150 if k == 0 else 15):
            t += rng.choice([0, 1, 2, 20, 21, 40])
            data.append((k, T0 + timedelta(seconds=t)))
    df = spark.createDataFrame(data, "k int, ts timestamp_ntz")
    expected = []
    for k in range(6):
        run = []
        for ts in sorted(t for key, t in data if key == k):
            if run and ts - run[-1] > timedelta(seconds=20):
                expected.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(ts)
        expected.append((k, run[0], run[-1], len(run)))
    found = collapse_repeats(df, ["k"], "ts", 20, block_seconds)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_announcement_repeats(spark):
    copies = [(1, T0 + timedelta(seconds=boot + 2 * i), "CSI_IP,10.0.0.9") for boot in (0, 100) for i in range(10)]
    log = spark.createDataFrame(copies + [(1, T0, "HELLO,10.0.0.9")], "device bigint, ts timestamp_ntz, msg string")
    found = sorted((r["first_ts"], r["copies"]) for r in discovery_dedup(log).collect())
    assert found == [(T0, 10), (T0 + timedelta(seconds=100), 10)]


def overlapping(seed=9):
    rng = random.Random(seed)
    packets = [(i, 0 if rng.random() < 1 / 3 else rng.randrange(1, 8), T0 + timedelta(seconds=rng.randrange(0, 20_000))) for i in range(400)]
    starts = [
        (s, rng.randrange(0, 8), T0 + timedelta(seconds=rng.randrange(0, 20_000)), rng.choice([1, 60, 4000, 2**31 - 1]))
        for s in range(60)
    ]
    # Bounds that meet packets exactly: the start counts, the end does not.
    starts += [(100 + i, p[1], p[2], 1) for i, p in enumerate(packets[:5])]
    starts += [(200 + i, p[1], p[2] - timedelta(seconds=60), 60) for i, p in enumerate(packets[:5])]
    return packets, starts


@pytest.mark.parametrize("seconds", [50, 100_000])
def test_packets_of_sessions(spark, seconds):
    packets, starts = overlapping()
    p = spark.createDataFrame(packets, "arrival bigint, device bigint, ts timestamp_ntz")
    s = spark.createDataFrame(starts, "session_id bigint, device bigint, started_at timestamp_ntz, n int")
    expected = [
        (sid, arrival)
        for sid, device, start, n in starts
        for arrival, d, ts in packets
        if d == device and start <= ts < start + timedelta(seconds=n)
    ]
    pairs = sessions.bound_packets(p, s, seconds).select("session_id", "arrival")
    assert sorted(map(tuple, pairs.collect())) == sorted(expected)
    counts = defaultdict(int)
    for sid, _ in expected:
        counts[sid] += 1
    found = sessions.packets_per_session(p, s, seconds)
    assert {r["session_id"]: r["packets"] for r in found.collect()} == counts


def test_sessions_from_repeated_starts(spark):
    sends = [(1, T0 + timedelta(seconds=3 * i), "start,60") for i in range(5)]
    sends += [(1, T0 + timedelta(seconds=500), "start,60"), (1, T0, "start,0"), (1, T0, "start,abc"), (2, T0, "stop,60"), (2, T0, "start, 7x")]
    log = spark.createDataFrame(sends, "device bigint, ts timestamp_ntz, msg string")
    found = sorted(map(tuple, sessions.sessions_from_starts(log).collect()))
    assert found == [(1, T0, 60, True, 5), (1, T0 + timedelta(seconds=500), 60, True, 1), (2, T0, 7, False, 1)]


def test_progress_and_first_packet(spark):
    data = [(i, "a" if i % 3 else "b", T0 + timedelta(seconds=i)) for i in range(30)]
    df = spark.createDataFrame(data, "arrival bigint, s string, ts timestamp_ntz")
    found = sorted(map(tuple, sessions.progress(df, ["s"]).collect()))
    expected = []
    for s in "ab":
        so_far = 0
        for tick in range(5, 31, 5):
            n = sum(1 for i, key, _ in data if key == s and tick - 5 <= i < tick)
            so_far += n
            expected.append((s, T0 + timedelta(seconds=tick), n, so_far))
    assert found == expected
    assert sorted((r["s"], r["arrival"]) for r in sessions.first_packets(df, ["s"], "arrival").collect()) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize("rows_per_block", [2, 1000])
@pytest.mark.parametrize("threshold", [1, 3, 15])
def test_failure_streaks(spark, rows_per_block, threshold):
    rng = random.Random(threshold)
    data = [(0 if rng.random() < 1 / 3 else rng.randrange(1, 6), i, rng.random() < 0.85) for i in range(400)]
    expected = {}
    for device in range(6):
        run = longest = counter = hits = 0
        for _, _, failed in (r for r in data if r[0] == device):
            run = run + 1 if failed else 0
            counter = counter + 1 if failed else 0
            longest = max(longest, run)
            if counter >= threshold:
                hits, counter = hits + 1, 0
        expected[device] = (longest, hits)
    df = spark.createDataFrame(data, "device bigint, arrival bigint, failed boolean")
    found = failure_streaks(df, threshold, rows_per_block)
    assert {r["device"]: (r["max_streak"], r["hits"]) for r in found.collect()} == expected


def test_tagging_keeps_rows_without_a_session(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "arrival bigint, s string")
    known = spark.createDataFrame([("a", "id-a", T0, "")], "s string, session_id string, captured_at timestamp_ntz, scenario string")
    found = sessions.tag_sessions(rows, known, ["s"]).select("arrival", "session_id", "captured_at", "scenario")
    assert sorted(map(tuple, found.collect())) == [(1, "id-a", T0, "N/A"), (2, None, None, None), (3, "id-a", T0, "N/A")]


def test_null_keys_and_orders_are_kept(spark):
    schema = "arrival bigint, k bigint, d date"
    rows = spark.createDataFrame([(1, None, None), (2, None, None), (3, 1, T0.date()), (None, 1, T0.date())], schema)
    assert sorted(r["seq"] for r in sessions.assign_seq(rows, ["k", "d"], "arrival").collect()) == [0, 0, 1, 1]
    assert sorted(r["id"] for r in sessions.assign_row_id(rows, "d", "k", "arrival").collect()) == [1, 2, 3, 4]


def test_row_ids_of_many_interleaved_sessions(spark):
    rows = spark.range(40_000).selectExpr("id AS arrival", "id % 20000 AS k", "date'2024-01-01' AS d")
    found = sessions.assign_row_id(rows, "d", "k", "arrival")
    assert found.selectExpr("count_if(id = k * 2 + 1 + int(arrival / 20000)) AS n").first().n == 40_000


def test_ticks_of_a_long_session_are_listed_in_runs(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    packets = spark.createDataFrame([("a", start + timedelta(seconds=s, milliseconds=500)) for s in range(0, 40, 2)], "device string, ts timestamp_ntz")
    starts = spark.createDataFrame([("a", 1, start, 25), ("a", 2, start + timedelta(seconds=7), 1), ("a", 3, start + timedelta(seconds=30), 500)], "device string, session_id bigint, started_at timestamp_ntz, n int")
    whole = sorted(map(tuple, sessions.progress_ticks(packets, starts, 1).collect()))
    monkeypatch.setattr(sessions, "TICKS_PER_ROW", 7)
    assert sorted(map(tuple, sessions.progress_ticks(packets, starts, 1).collect())) == whole
    assert [(i, t) for i, t, _ in whole] == [
        (i, start + timedelta(seconds=s)) for i, s in [(1, s) for s in range(25)] + [(2, 7)] + [(3, s) for s in range(30, 39)]
    ]
    assert [n for i, _, n in whole if i == 1] == [(s + 1) // 2 for s in range(25)]
    assert [r["session_id"] for r in sessions.sessions_without_packets(packets, starts).collect()] == [2]
