import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from csilake.operators import wire
from csilake.operators.streaks import failure_streaks
from csilake.schema import WIRE_NAMES
from csilake.sources import landed
from csilake.streaming import ingest, stateful, windows
from samples import frame, line

T0 = datetime(2024, 1, 1)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_ingest_equals_batch_over_restarts(spark, folder):
    table, checkpoint, path = f"{folder}/table", f"{folder}/checkpoint", f"{folder}/landed"
    lines = [line(i, rssi="bad" if i % 9 == 1 else "-40") if i % 7 else "CSI_IP,10.0.0.1" for i in range(60)]
    for part in range(3):
        landed.land_lines(frame(spark, lines[part * 20 : part * 20 + 20]), path)
        stream = ingest.read_line_stream(spark, path, files_per_trigger=2)
        ingest.start_ingest(stream, table, checkpoint).awaitTermination()
    expected, _ = wire.parse_lines(frame(spark, lines))
    found = spark.read.parquet(table)
    assert sorted(map(tuple, found.select(*WIRE_NAMES).collect())) == sorted(map(tuple, expected.select(*WIRE_NAMES).collect()))


def test_routing_and_its_repeat(spark, folder):
    path = f"{folder}/landed"
    landed.land_lines(frame(spark, [line(0), line(1, rssi="x"), "CSI_IP,1.2.3.4", "start,5", "hello", "CSI_DATA,1"]), path)
    stream = ingest.read_line_stream(spark, path)
    # The second run has lost its checkpoint and writes the same batch once more.
    for run in range(2):
        ingest.start_routing(stream, f"{folder}/out", f"{folder}/checkpoint{run}").awaitTermination()
    assert spark.read.parquet(f"{folder}/out/packets").count() == 1
    rejects = spark.read.parquet(f"{folder}/out/rejects")
    assert sorted(r["reason"] for r in rejects.collect()) == ["bad_number", "field_count"]
    assert sorted(r["route"] for r in spark.read.parquet(f"{folder}/out/messages").collect()) == ["discovery", "other", "start"]


def test_streaks_over_batches(spark, folder):
    rng = random.Random(2)
    data = [(rng.choice([1, 1, 1, 2, 3]), i, rng.random() < 0.8) for i in range(300)]
    schema = "device bigint, arrival bigint, failed boolean"
    for part in range(3):
        spark.createDataFrame(data[part * 100 : part * 100 + 100], schema).write.mode("append").parquet(f"{folder}/in")
        events = stream_of(spark, f"{folder}/in", schema)
        stateful.start_streaks(events, f"{folder}/state", f"{folder}/checkpoint", 4).awaitTermination()
        expected = failure_streaks(spark.createDataFrame(data[: part * 100 + 100], schema), 4)
        found = stateful.streaks_so_far(spark, f"{folder}/state")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_session_timer_over_batches(spark, folder):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        device, ts = rng.choice([1, 1, 2]), T0 + timedelta(seconds=i)
        rows.append((device, ts, True, None, None) if rng.random() < 0.8 else (device, ts, False, i, rng.choice([0, 3, 30, 90])))
    schema = "device bigint, ts timestamp_ntz, is_packet boolean, session_id bigint, n int"
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).write.mode("append").parquet(f"{folder}/in")
        stream = stream_of(spark, f"{folder}/in", schema)
        stateful.start_session_timer(stream, f"{folder}/state", f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    expected, running = {}, {}
    for device, ts, is_packet, session, n in rows:
        current = running.get(device)
        if is_packet and current is not None and ts < expected[current][2]:
            expected[current][3] += 1
        elif not is_packet and n > 0 and (current is None or ts >= expected[current][2]):
            running[device] = session
            expected[session] = [device, ts, ts + timedelta(seconds=n), 0]
    found = stateful.sessions_so_far(spark, f"{folder}/state", f"{folder}/counts")
    assert {r["session_id"]: [r["device"], r["started_at"], r["ends_at"], r["packets"]] for r in found.collect()} == expected


def test_progress_with_late_rows(spark, folder):
    data = [(i, "s" if i % 3 else "t", T0 + timedelta(seconds=i)) for i in range(60)]
    late = sorted(data, key=lambda r: (r[0] % 3 == 0, r[0]))  # one device lands last
    schema = "arrival bigint, s string, ts timestamp_ntz"
    for part in range(3):
        spark.createDataFrame(late[part * 20 : part * 20 + 20], schema).write.mode("append").parquet(f"{folder}/in")
        packets = stream_of(spark, f"{folder}/in", schema)
        windows.start_progress(packets, f"{folder}/out", f"{folder}/checkpoint", ["s"], "15 seconds").awaitTermination()
    expected = {}
    for i, s, _ in data:
        key = (s, T0 + timedelta(seconds=15 * (i // 15) + 15))
        expected[key] = expected.get(key, 0) + 1
    assert {(r["s"], r["tick"]): r["packets"] for r in windows.progress_so_far(spark, f"{folder}/out", ["s"]).collect()} == expected


def test_announcements_do_not_depend_on_cuts(spark, folder):
    log = [(1, T0 + timedelta(seconds=2 * i + h * 3600), "CSI_IP,10.0.0.1") for h in range(2) for i in range(10)]
    log += [(1, T0, "HELLO,1"), (2, T0, "CSI_IP,10.0.0.2")]
    schema = "device bigint, ts timestamp_ntz, msg string"
    for cuts in (1, 4):
        rows = log if cuts == 1 else log[::-1]
        for part in range(cuts):
            spark.createDataFrame(rows[part::cuts], schema).write.mode("append").parquet(f"{folder}/log{cuts}")
            stream = stream_of(spark, f"{folder}/log{cuts}", schema)
            windows.start_announcements(stream, f"{folder}/out{cuts}", f"{folder}/c{cuts}").awaitTermination()
    one, four = (sorted(map(tuple, windows.announcements_so_far(spark, f"{folder}/out{c}", 10).collect())) for c in (1, 4))
    assert one == four and [r[-1] for r in one] == [10, 10, 1]


def test_session_timer_counts_late_packets(spark, folder):
    at = lambda s: T0 + timedelta(seconds=s)
    parts = [[(1, at(0), False, 7, 10), (1, at(1), True, None, None)], [(1, at(20), False, 8, 10)], [(1, at(5), True, None, None), (1, at(25), True, None, None)]]
    schema = "device bigint, ts timestamp_ntz, is_packet boolean, session_id bigint, n int"
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/in")
        stream = stream_of(spark, f"{folder}/in", schema)
        stateful.start_session_timer(stream, f"{folder}/state", f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    found = stateful.sessions_so_far(spark, f"{folder}/state", f"{folder}/counts")
    assert sorted((r["session_id"], r["packets"]) for r in found.collect()) == [(7, 2), (8, 1)]


def test_rejects_of_the_stream_are_kept(spark, folder):
    landed.land_lines(frame(spark, [line(0), line(1, rssi="x"), "CSI_DATA,1"]), f"{folder}/in")
    stream = ingest.read_line_stream(spark, f"{folder}/in")
    ingest.start_ingest(stream, f"{folder}/t", f"{folder}/c", rejects=f"{folder}/r").awaitTermination()
    assert spark.read.parquet(f"{folder}/t").count() == 1
    assert sorted(r["reason"] for r in spark.read.parquet(f"{folder}/r").collect()) == ["bad_number", "field_count"]


def test_scratch_must_be_shared(spark, monkeypatch):
    import pytest

    from csilake import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError):
        session.new_folder(Session(), "x")
    assert session.new_folder(spark, "x") != session.new_folder(spark, "x")
