import os
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from csilake.operators import views, wire
from csilake.schema import STORED_NAMES, WIRE_NAMES
from csilake.sources import landed, tables
from csilake.sources.collector_sqlite import CollectorSqlite, LAYOUTS, create_statement
from samples import SAMPLE, frame, line


def write_collector_file(path, layout, rows):
    db = sqlite3.connect(path)
    db.execute(create_statement(layout))
    _, columns = LAYOUTS[layout]
    db.executemany(
        f"INSERT INTO csi_data ({', '.join(columns)}) VALUES ({', '.join('?' * len(columns))})",
        [[row[{v: k for k, v in STORED_NAMES[layout].items()}.get(c, c)] for c in columns] for row in rows],
    )
    db.commit()
    db.close()


def stored(seq, stamp, scenario, **fields):
    values = dict(zip(WIRE_NAMES, line(seq, **fields).split(",", 24)))
    values["data"] = values["data"].strip('"')
    return {**values, "captured_at": stamp, "scenario": scenario}


@pytest.fixture
def collected(spark, folder):
    spark.dataSource.register(CollectorSqlite)
    os.makedirs(f"{folder}/sub")
    for i, layout in enumerate(["desktop", "mobile", "desktop", "mobile"]):
        stamp = "2024-03-01T10:00:00.250000" if layout == "desktop" else "2024-03-01 10:00:00"
        rows = [stored(s, stamp, f"walk-{s % 2}", rssi="bad" if s == 3 else "-40") for s in range(50)]
        write_collector_file(f"{folder}/{'sub/' if i > 1 else ''}f{i}.db", layout, rows)
    write_collector_file(f"{folder}/empty.db", "mobile", [])
    return folder


def test_reads_both_layouts(spark, collected):
    df = spark.read.format("collector_sqlite").load(collected)
    assert df.count() == 200
    row = df.where("seq = 7").orderBy("file").collect()
    assert [r["captured_at"] for r in row] == [
        datetime(2024, 3, 1, 10, 0, 0, 250000), datetime(2024, 3, 1, 10), datetime(2024, 3, 1, 10, 0, 0, 250000), datetime(2024, 3, 1, 10)
    ]
    assert {(r["id"], r["mac"], r["rssi"], r["rate"], r["local_timestamp"], r["scenario"]) for r in row} == {
        (8, "94:d9:b3:80:8c:81", -40, 11.0, 2751923, "walk-1")
    }
    # A text in a number column is kept in the file; here it is null and named.
    bad = df.where(F.size("bad_fields") > 0).collect()
    assert [(r["seq"], r["rssi"], r["bad_fields"]) for r in bad] == [(3, None, ["rssi"])] * 4


def test_splits_a_file_by_id(spark, collected):
    reader = spark.read.format("collector_sqlite").option("bytes_per_split", 4096).option("columns", "id,file,seq")
    df = reader.load(collected)
    assert df.columns == ["id", "file", "seq"]
    assert df.rdd.getNumPartitions() > 8
    assert df.select("file", "id").distinct().count() == df.count() == 200


def test_pushes_filters(spark, collected):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("collector_sqlite").option("pushdown", "true").load(collected)
        found = df.where("id > 10 and id <= 20 and scenario = 'walk-1' and rssi < 0").select("id")
        assert sorted({r["id"] for r in found.collect()}) == [12, 14, 16, 18, 20]
        assert found.count() == 20
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "rssi" in plan.split("Filter")[1] and "(scenario" not in plan.split("Filter")[1].split("BatchScan")[0].replace("isnotnull(scenario", "")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_writes_files_the_reader_and_sqlite_understand(spark, folder):
    spark.dataSource.register(CollectorSqlite)
    rows, _ = wire.parse_lines(frame(spark, [line(i) for i in range(25)]))
    stamped = rows.select(F.lit(datetime(2024, 5, 6, 7, 8, 9)).cast("timestamp_ntz").alias("captured_at"), F.lit("s").alias("scenario"), *WIRE_NAMES)
    for layout in ("desktop", "mobile"):
        path = f"{folder}/{layout}"
        writer = stamped.coalesce(1).write.format("collector_sqlite").option("layout", layout).option("rows_per_file", 10)
        writer.mode("append").save(path)
        names = os.listdir(path)
        assert len(names) == 3 and all(n.endswith(".db") for n in names)
        db = sqlite3.connect(f"{path}/{sorted(names)[0]}")
        assert [c[1] for c in db.execute("PRAGMA table_info(csi_data)")] == ["id", *LAYOUTS[layout][1]]
        stamp = db.execute(f"SELECT {STORED_NAMES[layout]['captured_at']} FROM csi_data").fetchone()[0]
        assert stamp == ("2024-05-06T07:08:09" if layout == "desktop" else "2024-05-06 07:08:09")
        back = spark.read.format("collector_sqlite").load(path)
        assert sorted(map(tuple, back.select(*stamped.columns).collect())) == sorted(map(tuple, stamped.collect()))
    stamped.limit(3).write.format("collector_sqlite").mode("overwrite").save(f"{folder}/desktop")
    assert spark.read.format("collector_sqlite").load(f"{folder}/desktop").count() == 3


def test_stored_values_of_any_kind(spark, folder):
    spark.dataSource.register(CollectorSqlite)
    stamp = "2024-03-01T10:00:00"
    values = [(5.0, 1), (5.5, 1.5), (2**31, 2**63 - 1), (-(2**31), -(2**63)), (-(2**31) - 1, 9.3e18), (None, b"7"), ("x", "y"), (float("inf"), float("inf"))]
    write_collector_file(f"{folder}/a.db", "desktop", [stored(i, stamp, "s") for i in range(len(values))])
    db = sqlite3.connect(f"{folder}/a.db")
    for i, (rssi, rate) in enumerate(values):
        db.execute("UPDATE csi_data SET rssi = ?, rate = ?, local_timestamp = ? WHERE id = ?", (rssi, rate, rate, i + 1))
    db.commit()
    db.close()
    rows = spark.read.format("collector_sqlite").load(folder).orderBy("id").collect()
    assert [r["rssi"] for r in rows] == [5, None, None, -(2**31), None, None, None, None]
    assert [r["rate"] for r in rows][:2] == [1.0, 1.5] and [r["rate"] for r in rows][5:7] == [None, None]
    whole = [None if "local_timestamp" in r["bad_fields"] else r["local_timestamp"] for r in rows]
    assert whole == [1, None, 2**63 - 1, -(2**63), None, None, None, None]
    assert ["rssi" in r["bad_fields"] for r in rows] == [False, True, True, False, True, True, True, True]


def test_files_of_a_job_show_at_once(spark, folder):
    spark.dataSource.register(CollectorSqlite)
    rows, _ = wire.parse_lines(frame(spark, [line(i) for i in range(25)]))
    stamped = rows.select(F.lit(datetime(2024, 5, 6, 7, 8, 9)).cast("timestamp_ntz").alias("captured_at"), F.lit("s").alias("scenario"), *WIRE_NAMES)
    read = lambda: spark.read.format("collector_sqlite").load(folder).count()
    stamped.repartition(3).write.format("collector_sqlite").mode("append").save(folder)
    assert read() == 25 and all(x.endswith(".db") for x in os.listdir(folder))
    # a commit that ended half way: one file moved, one not
    names = sorted(os.listdir(folder))
    os.makedirs(f"{folder}/.job-1")
    os.replace(f"{folder}/{names[0]}", f"{folder}/.job-1/{names[0]}")
    with open(f"{folder}/.job-1/coming", "w") as out:
        out.write("\n".join(names[:2]))
    files = {r["file"] for r in spark.read.format("collector_sqlite").load(folder).select("file").collect()}
    assert {os.path.basename(x) for x in files} == set(names[2:])
    # a failing job leaves nothing
    bad = stamped.withColumn("seq", F.when(F.col("seq") == 20, F.raise_error(F.lit("no"))).otherwise(F.col("seq")).cast("int"))
    before = sorted(os.listdir(folder))
    with pytest.raises(Exception):
        bad.write.format("collector_sqlite").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == before


def test_viewer_reads_newest_first(spark, collected):
    df = spark.read.format("collector_sqlite").load(f"{collected}/f0.db")
    assert [r["id"] for r in views.newest_first(df).select("id").collect()] == list(range(50, 0, -1))
    top = views.card(views.newest_first(df, 2)).collect()
    assert [tuple(r)[2:] for r in top] == [("94:d9:b3:80:8c:81", -40, "13 (2)")] * 2


def test_landed_lines(spark, folder):
    lines = frame(spark, [line(0), line(1) + "  ", "C", "", "CSI_IP,1"])
    landed.land_lines(lines.coalesce(1), folder)
    read = landed.read_lines(spark, folder)
    assert [r["value"] for r in read.orderBy("file", "file_block", "line").collect()] == [r["value"] for r in lines.collect()]
    assert sorted(r["value"] for r in landed.ingest_lines(read).collect()) == [line(0), line(1)]
    nulls = spark.createDataFrame([(None,), (SAMPLE,)], "value string")
    assert landed.ingest_lines(nulls).count() == 1


def test_tables(spark, folder):
    rows = spark.createDataFrame([(d, s, i) for i in range(4) for d in ("2024-01-01", "2024-01-02") for s in "ab"], "session_date string, scenario string, v int")
    tables.append_sessions(rows, f"{folder}/t")
    tables.append_sessions(rows.limit(3), f"{folder}/t")
    assert tables.read_table(spark, f"{folder}/t").count() == 19
    # A later layout with one more column does not lose the older rows.
    tables.append_sessions(rows.limit(1).withColumn("extra", F.lit(1)), f"{folder}/t")
    grown = tables.read_table(spark, f"{folder}/t")
    assert grown.count() == 20 and "extra" in grown.columns

    keys = ["session_date", "scenario"]
    for _ in range(2):
        tables.overwrite_session(rows, f"{folder}/o", keys)
    tables.overwrite_session(rows.where("scenario = 'a' and session_date = '2024-01-01' and v = 0"), f"{folder}/o", keys)
    assert tables.read_table(spark, f"{folder}/o").count() == 13

    rows.write.parquet(f"{folder}/plain")
    tables.delete_all(spark, f"{folder}/plain")
    assert spark.read.parquet(f"{folder}/plain").count() == 0
    assert spark.read.parquet(f"{folder}/plain").columns == rows.columns


def test_csv(spark, folder):
    rows = spark.createDataFrame([(1, 'a,"b"\\', 2.5), (2, "", None), (3, None, 0.0), (4, "two\nlines", 1.0)], "id int, s string, x double")
    tables.export_csv(rows, folder)
    assert tables.read_csv(spark, folder, "id int, s string, x double").orderBy("id").collect() == rows.collect()


def test_functions_travel_to_workers_without_the_package(spark, folder):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from csilake.streaming.stateful import open_sessions

    with open(f"{folder}/sent", "wb") as out:
        out.write(cloudpickle.dumps([open_sessions, CollectorSqlite]))
    code = "import pyspark.cloudpickle as c, sys; print(len(c.loads(open('sent', 'rb').read())), 'csilake' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.split() == ["2", "False"], done.stderr


def test_collector_files_of_any_name_and_long_lists(spark, folder):
    spark.dataSource.register(CollectorSqlite)
    rows = [stored(i, "2024-03-01T10:00:00", "walk") for i in range(4)]
    write_collector_file(f"{folder}/survey.sqlite3", "desktop", rows[:2])
    write_collector_file(f"{folder}/no ending", "desktop", rows[2:])
    write_collector_file(f"{folder}/.hidden.db", "desktop", rows)
    found = spark.read.format("collector_sqlite").load(folder)
    assert found.count() == 4
    assert found.where(F.col("id").isin(*range(1, 2_000))).count() == 4
