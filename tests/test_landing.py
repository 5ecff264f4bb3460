"""Landed lines are written and numbered without moving them more than needed."""

import functools
import glob
import os
import re

import pytest
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from check import TABLES, compare, tables_db
from csilake.operators import sessions, wire
from csilake.plans import inputs
from csilake.plans.oracle import ORACLE
from csilake.plans.queries import QUERIES
from csilake.session import CO_PARTITION, setting
from csilake.sources import landed, tables
from samples import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_landed_lines_are_numbered_without_a_shuffle(spark, folder):
    rows = spark.range(0, 1000, 1, 5).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("day"), F.format_string("%04d", "id").alias("value"))
    landed.land_lines(rows, folder, ["day"])
    lines = landed.read_lines(spark, folder)
    numbered = sessions.number_blocks(lines, ["day", "file", "file_block"], "nr", 11)
    want = [r.value for r in lines.orderBy("day", "file", "file_block", "line").collect()]
    assert [(r.nr, r.value) for r in numbered.orderBy("nr").collect()] == [(11 + i, v) for i, v in enumerate(want)]
    plan = plan_of(numbered)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # nor are the rows of any order shuffled again for the counts of their ranges
    assert "SortMergeJoin" not in plan_of(sessions.number_rows(rows, ["value"], "nr"))
    assert sessions.number_blocks(lines.where("value < ''"), ["day", "file", "file_block"], "nr").count() == 0


def test_lines_are_landed_without_a_sort(spark, folder, monkeypatch):
    seen, name, write = [], "spark.sql.maxConcurrentOutputFileWriters", DataFrameWriter.text
    before = spark.conf.get(name)
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: (seen.append(int(spark.conf.get(name))), write(self, *a, **k)))
    # more folders than are written side by side
    rows = spark.range(600).select((F.col("id") % 200).cast("string").alias("day"), F.col("id").cast("string").alias("value"))
    landed.land_lines(rows, folder, ["day"])
    assert seen == [landed.OPEN_FOLDERS] and spark.conf.get(name) == before
    assert sorted((int(r.day), int(r.value)) for r in spark.read.text(folder).collect()) == sorted((i % 200, i) for i in range(600))


BLOCKS = ["day", "file", "file_block"]


def shuffled(df):
    """Columns of each shuffle of the plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [columns for columns in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", df._jdf.queryExecution().explainString(mode))]


@pytest.fixture
def landed_days(spark, folder):
    """Lines of three days and of none, in several files."""
    rows = spark.range(0, 1000, 1, 5).select(F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("day"), F.format_string("%04d", "id").alias("value"))
    landed.land_lines(rows, f"{folder}/in", ["day"])
    return landed.read_lines(spark, f"{folder}/in")


def test_chunks_hold_whole_blocks_that_follow_each_other(landed_days):
    chunked, chunks = sessions.chunk_blocks(landed_days, BLOCKS, rows_per_chunk=120)
    blocks = chunked.groupBy(*BLOCKS).agg(F.count("*").alias("n"), F.collect_set("chunk").alias("chunks")).orderBy(*BLOCKS).collect()
    before, want = 0, []
    for block in blocks:
        want.append([before // 120])
        before += block.n
    assert before == 1000 and [b.chunks for b in blocks] == want and len({c for w in want for c in w}) > 3
    assert chunks == sessions.Chunks("chunk", 2 * 9)
    assert sessions.chunk_blocks(landed_days.where("value < ''"), BLOCKS)[1].buckets == 2


def test_numbers_do_not_depend_on_chunks(spark, landed_days):
    chunked, chunks = sessions.chunk_blocks(landed_days, BLOCKS, rows_per_chunk=120)
    tables_before = spark.catalog.listTables()
    by_chunk = sessions.number_blocks(chunked, BLOCKS, "nr", 11, chunks)
    assert spark.catalog.listTables() == tables_before
    plain = sessions.number_blocks(landed_days, BLOCKS, "nr", 11)
    assert sorted((r.nr, r.value) for r in by_chunk.collect()) == sorted((r.nr, r.value) for r in plain.collect())
    # chunks only say where rows are stored
    stray = chunked.withColumn("chunk", F.lit(0).cast("bigint"))
    assert sessions.number_blocks(stray, BLOCKS, "nr", chunks=chunks).count() == 1000


def test_rows_in_chunks_are_tagged_and_appended_where_they_lie(spark, folder, landed_days):
    chunked, chunks = sessions.chunk_blocks(landed_days.withColumn("mac", F.substring("value", 4, 1)), BLOCKS, rows_per_chunk=120)
    rows = sessions.number_blocks(chunked, BLOCKS, "nr", chunks=chunks).withColumn("mac", F.nullif("mac", F.lit("7")))
    # sessions that are not known, unused, without a key, and one that comes twice
    tags = spark.createDataFrame(
        [(d, m, f"{d}-{m}-{k}", "" if m == "1" else "walk") for d in ("1", "2", "9", None) for m in ("0", "1", "2", "5", None) for k in range(2 if m == "5" else 1)],
        "day string, mac string, session_id string, scenario string",
    ).withColumns({"captured_at": F.lit("2024-05-01").cast("timestamp_ntz"), "day": F.col("day").cast("int")})
    shape = ["nr", "value", "day", "mac", "session_id", "captured_at", "scenario"]
    want = sessions.tag_sessions(rows, tags, ["day", "mac"])
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        tagged = sessions.tag_sessions(rows, tags, ["day", "mac"], chunks)
        with setting(spark, CO_PARTITION, "false"):
            assert shuffled(tagged.select("*")) and not any("value#" in columns for columns in shuffled(tagged.select("*")))
        tables.append_sessions(tagged.withColumn("session_date", F.coalesce("day", F.lit(0))), f"{folder}/t", gathered=True)
    stored = [tuple(r) for r in spark.read.parquet(f"{folder}/t").select(*shape).collect()]
    assert sorted(stored, key=str) == sorted((tuple(r) for r in want.select(*shape).collect()), key=str) and len(stored) > 1000


def test_ingested_packets_are_shuffled_by_no_step(spark, monkeypatch):
    seen, append = [], tables.append_sessions

    def appended(rows, path, gathered=False):
        with setting(spark, CO_PARTITION, "false"):
            seen.append((gathered, shuffled(rows.select("*"))))
        append(rows, path, gathered)

    monkeypatch.setattr(tables, "append_sessions", appended)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        QUERIES["ingest_pipeline"](spark, SF)
    [(gathered, columns)] = seen
    assert gathered and columns and not any("data#" in c for c in columns)


def test_lines_landed_compressed_are_the_same(spark, folder, monkeypatch):
    monkeypatch.setattr(landed, "LINES_PER_FILE", 100)
    rows = spark.range(0, 1000, 1, 2).select((F.col("id") % 2).cast("string").alias("day"), F.format_string("%04d é", "id").alias("value"))
    landed.land_lines(rows, folder, ["day"], "gzip")
    lines = landed.read_lines(spark, folder)
    assert sorted(r.value for r in lines.collect()) == [f"{i:04d} é" for i in range(1000)]
    sizes = [r["count"] for r in lines.groupBy("file").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 100
    assert all(f.endswith(".gz") for day in ("0", "1") for f in os.listdir(f"{folder}/day={day}") if f.startswith("part-"))
    numbered = sessions.number_blocks(lines, BLOCKS, "nr")
    want = [r.value for r in lines.orderBy(*BLOCKS, "line").collect()]
    assert [r.value for r in numbered.orderBy("nr").collect()] == want


def test_lines_come_back_with_their_senders(spark, folder):
    lines = [(1, "a\tb "), (None, "\tc"), (70000, " é,d"), (2, ""), (3, None)]
    landed.land_lines(spark.createDataFrame(lines, "device bigint, value string"), folder, sender="device")
    read = landed.read_lines(spark, folder, "device").select("device", "value").collect()
    assert {tuple(r) for r in read} == {("" if d is None else str(d), v or "") for d, v in lines}


def tables_with(tmp_path, events):
    """Folder of the smallest tables with other events."""
    for name in TABLES:
        if name != "events":
            os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "parts"))
    os.symlink(glob.glob(f"{tmp_path}/parts/*.parquet")[0], tmp_path / "events.parquet")
    return str(tmp_path)


def test_devices_of_one_mac_text_keep_their_packets_apart(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    n = events.count()
    # the mac has two digits for these, which are 100, 101 and 10f in hex
    copies = [events.withColumns({"event_id": F.col("event_id") + k * n, "user_id": 256 * F.lit(high) + F.col("user_id") % 3}) for k, high in enumerate((256, 257, 271))]
    folder = tables_with(tmp_path, functools.reduce(DataFrame.unionByName, copies))
    assert compare(QUERIES["ingest_pipeline"](spark, folder), tables_db(folder), ORACLE["ingest_pipeline"]) is None


def test_packets_without_a_device_are_a_session_of_their_date(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = tables_with(tmp_path, events.withColumn("user_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id"))))
    found = QUERIES["ingest_pipeline"](spark, folder).where("captured_at is not null")
    assert found.where("kind is null").count() == 0
    no_device = found.where("not contains(kind, '-')").collect()
    accepted = wire.accepted(wire.classify_lines(inputs.csi_lines(spark, folder))).where("device is null").groupBy("session_date").count().collect()
    assert {r.kind: r.n for r in no_device} == {r.session_date.strftime("%Y%m%d"): r["count"] for r in accepted} and accepted
