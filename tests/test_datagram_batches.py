"""What a batch of a datagram stream costs besides its records: the query's logs, and collections in the workers."""

import gc

import pytest

from csilake.plans import stream_queries
from csilake.sources.datagrams import LogStreamReader, Range, record
from pyspark.sql.streaming import DataStreamWriter
from samples import SF

MANAGER = "spark.sql.streaming.checkpointFileManagerClass"


def test_logs_of_the_query_start_no_processes(spark, monkeypatch):
    seen, start = [], DataStreamWriter.start

    def spy(writer, *args, **options):
        seen.append(spark.conf.get(MANAGER, None))
        return start(writer, *args, **options)

    before = spark.conf.get(MANAGER, None)
    monkeypatch.setattr(DataStreamWriter, "start", spy)
    rows = stream_queries.stream_datagrams(spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert sorted(r.arrival for r in rows.select("arrival").collect()) == sorted(r.event_id for r in events.select("event_id").collect())
    assert seen == [stream_queries.LOG_FILES] * stream_queries.BATCHES and spark.conf.get(MANAGER, None) == before


@pytest.mark.parametrize("frozen", [0, 5])
def test_a_worker_spares_its_imports_once(folder, monkeypatch, frozen):
    count, calls = [frozen], []
    monkeypatch.setattr(gc, "get_freeze_count", lambda: count[0])
    monkeypatch.setattr(gc, "freeze", lambda: (calls.append(1), count.__setitem__(0, 9)))
    with open(f"{folder}/a.log", "wb") as out:
        size = out.write(record(b"one", 1) + record(b"two", 2))
    reader = LogStreamReader({"path": folder})
    for _ in range(2):
        assert [v for batch in reader.read(Range(f"{folder}/a.log", 0, size)) for v in batch.column("value").to_pylist()] == [b"one", b"two"]
    assert len(calls) == (frozen == 0)
