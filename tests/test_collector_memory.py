"""A task that writes collector files holds a few rows, whatever the size of a file."""

import datetime as dt
import glob
import sqlite3
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from csilake.sources.collector_sqlite import SqliteWriter


@pytest.mark.parametrize("rows_per_file", [20_000, 7_001])
def test_a_collector_file_does_not_fill_memory(spark, folder, rows_per_file):
    schema = StructType.fromDDL("id bigint, captured_at timestamp_ntz, scenario string, data string")
    writer = SqliteWriter(schema, {"path": folder, "rows_per_file": str(rows_per_file)}, False)
    stamp = dt.datetime(2024, 5, 1)

    def batches():
        for low in range(0, 20_000, 10_000):
            ids = list(range(low, low + 10_000))
            yield pa.RecordBatch.from_pydict({"id": ids, "captured_at": [stamp] * len(ids), "scenario": ["a"] * len(ids), "data": [f"{i:01000d}" for i in ids]})

    tracemalloc.start()
    written = writer.write(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a file of 20 MB; its bytes went through Python whole
    assert peak < 16e6
    writer.commit([written])
    found = []
    for path in glob.glob(f"{folder}/*.db"):
        with sqlite3.connect(path) as db:
            found += db.execute("SELECT id, timestamp, scenario, data FROM csi_data").fetchall()
    assert sorted(found) == [(i, stamp.isoformat(), "a", f"{i:01000d}") for i in range(20_000)]
    assert len(written.files) == -(-20_000 // rows_per_file)
