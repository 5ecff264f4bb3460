"""Streams with Spark's state against plain Python, over several landings and restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from csilake.streaming import timed

DAY = dt.datetime(2024, 5, 1)
MESSAGES = "device long, ts timestamp_ntz, is_packet boolean, session_id long, n int"


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def land(spark, rows, schema, path, start):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    query = start(spark.readStream.schema(schema).parquet(path))
    query.awaitTermination()
    return query


def test_sessions_end_as_time_passes(spark, folder):
    """Sessions that reach over landings, repeated and overlapping starts, devices that fall silent."""
    rng = random.Random(6)
    rows = []
    for second in sorted(rng.randrange(3000) for _ in range(900)):
        device = rng.choice([1, 1, 1, 2, 3])
        if second > 2000 and device == 3:
            continue  # silent from here on: its last session ends by the clock alone
        if rng.random() < 0.1:
            rows.append((device, at(second), False, len(rows), rng.choice([0, 5, 60, 400])))
        else:
            rows.append((device, at(second), True, None, None))
    running, ended = {}, {}
    for device, ts, packet, number, n in sorted(rows, key=lambda r: (r[1], r[2], r[3] or 0)):
        open_ = running.get(device)
        if open_ and ts >= open_[1]:
            running.pop(device)
            open_ = None
        if packet and open_:
            ended[open_[0]][4] += 1
        elif not packet and not open_ and n > 0:
            running[device] = (number, ts + dt.timedelta(seconds=n))
            ended[number] = [number, device, ts, ts + dt.timedelta(seconds=n), 0]
    last = max(r[1] for r in rows)
    want = sorted(tuple(s) for s in ended.values() if s[3] <= last)
    start = lambda stream: timed.start_session_ends(stream, f"{folder}/ended", f"{folder}/checkpoint")
    cuts = [0, 250, 251, 600, len(rows)]
    rows.sort(key=lambda r: r[1])
    for low, high in zip(cuts, cuts[1:]):
        # rows of one instant land together
        while high < len(rows) and rows[high][1] == rows[high - 1][1]:
            high += 1
        while low and rows[low][1] == rows[low - 1][1]:
            low += 1
        land(spark, rows[low:high], MESSAGES, f"{folder}/landed", start)
    stored = spark.read.parquet(f"{folder}/ended").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ends_at")})
    assert sorted(tuple(r) for r in stored.collect()) == want and any(s[1] == 3 for s in want)


def test_packets_meet_their_session_whichever_lands_first(spark, folder):
    packets, sessions = "arrival long, device long, ts timestamp_ntz", "device long, session_id long, started_at timestamp_ntz, n int"
    landings = [
        ([(1, 7, at(5)), (2, 7, at(12)), (3, 8, at(12))], []),
        ([(4, 7, at(40))], [(7, 100, at(10), 20), (8, 101, at(12), 1), (7, 102, at(11), 100_000)]),
        ([(5, 7, at(10_800 + 11)), (6, 7, at(10_800 + 10))], [(7, 103, at(10_000), 2000)]),
        # the watermark has passed this packet and this start
        ([(7, 7, at(13))], [(7, 104, at(1), 50)]),
    ]
    dropped = 0
    for left, right in landings:
        spark.createDataFrame(left, packets).write.mode("append").parquet(f"{folder}/p")
        spark.createDataFrame(right, sessions).write.mode("append").parquet(f"{folder}/s")
        query = timed.start_session_packets(
            spark.readStream.schema(packets).parquet(f"{folder}/p"), spark.readStream.schema(sessions).parquet(f"{folder}/s"), f"{folder}/out", f"{folder}/checkpoint"
        )
        query.awaitTermination()
        dropped += timed.rows_dropped(query)
    got = sorted((r.arrival, r.session_id) for r in spark.read.parquet(f"{folder}/out").collect())
    # session 102 is cut to three hours, so it holds packet 6 but not packet 5
    assert got == [(2, 100), (2, 102), (3, 101), (4, 102), (5, 103), (6, 102), (6, 103)]
    assert dropped == 2


def test_packets_land_again(spark, folder):
    schema = "arrival long, device long, seq int, ts timestamp_ntz"
    rows = [(i, i % 3, i // 3, at(i)) for i in range(300)]
    start = lambda stream: timed.start_packets_once(stream, ["device", "seq"], f"{folder}/once", f"{folder}/checkpoint", "10 minutes")
    for part in (rows[:100], rows[50:150], rows[:150], rows[150:] + rows[200:250]):
        land(spark, part, schema, f"{folder}/landed", start)
    assert sorted(r.arrival for r in spark.read.parquet(f"{folder}/once").collect()) == list(range(300))
    late = land(spark, [(1000, 9, 9, at(-5000))], schema, f"{folder}/landed", start)
    assert timed.rows_dropped(late) == 1


def test_listening_windows_begin_when_listening_does(spark):
    from csilake.operators import control

    log = [(1, at(100), "CSI_IP,a"), (1, at(90), "HELLO"), (1, at(174), "CSI_IP,b"), (1, at(300), "CSI_IP,c"), (1, at(380), "CSI_IP,d"), (2, at(10), "CSI_IP,e"), (3, at(5), "CSI_IP,f")]
    listening = [(10, 1, at(99)), (11, 1, at(174)), (12, 1, at(304)), (13, 2, at(11)), (14, 3, at(5))]
    found = control.discovery_listen(
        spark.createDataFrame(log, "device int, ts timestamp_ntz, msg string"), spark.createDataFrame(listening, "listen_id int, device int, listen_from timestamp_ntz")
    )
    assert sorted((r.listen_id, r.address, r.ts) for r in found.collect()) == [(10, "a", at(100)), (11, "b", at(174)), (14, "f", at(5))]
