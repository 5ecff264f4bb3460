"""Ids that go on over appends, pages by stored ids, layouts by sender and by user."""

import re

from pyspark.sql import functions as F

from csilake.operators import control, users
from csilake.plans import inputs
from csilake.sources import numbered, tables
from samples import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("nr"), (F.col("id") % 7).alias("k")).repartition(4)


def test_ids_go_on(spark, folder):
    path = f"{folder}/t"
    assert numbered.high_water(spark, path) == 0
    assert numbered.append_numbered(rows(spark, 0, 500), path, ["nr"]) == 1
    assert numbered.append_numbered(rows(spark, 0, 0), path, ["nr"]) == 501
    assert numbered.append_numbered(rows(spark, 500, 900), path, ["nr"], rows_per_file=50) == 501
    stored = {r.id: r.nr for r in spark.read.parquet(path).collect()}
    assert stored == {i + 1: i for i in range(900)}
    text = plan(numbered.greatest_id(spark, path))
    assert "PushedAggregation: [MAX(id)]" in text and "PushedGroupBy: []" in text


def test_pages_newest_first(spark, folder):
    path = f"{folder}/t"
    for low in range(0, 1000, 100):
        numbered.append_numbered(rows(spark, low, low + 100), path, ["nr"])
    assert [r.id for r in numbered.page(spark, path, 5).collect()] == [1000, 999, 998, 997, 996]
    assert [r.id for r in numbered.page(spark, path, 3, before=400).collect()] == [399, 398, 397]
    assert [r.id for r in numbered.page(spark, path, 5, before=3).collect()] == [2, 1]
    assert numbered.page(spark, path, 5, before=1).collect() == []
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(id,996\), LessThanOrEqual\(id,1000\)", plan(numbered.page(spark, path, 5)))
    # files hold narrow ranges, so a page lies in few of them
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    assert files.where("high > 995").count() <= 2 < files.count()


def test_pages_over_deleted_rows(spark, folder):
    spark.range(1, 2001).where("id % 10 = 0 or id < 5").write.parquet(f"{folder}/gaps")
    assert [r.id for r in numbered.page(spark, f"{folder}/gaps", 30).collect()] == list(range(2000, 1700, -10))
    assert len(numbered.page(spark, f"{folder}/gaps", 1000).collect()) == 204


def test_senders_prune_folders(spark, folder):
    packets = spark.range(2000).select((F.col("id") % 200).cast("string").alias("mac"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "mac string, id long")
    )
    path = f"{folder}/by-sender"
    tables.append_by_sender(packets, path)
    stored = tables.read_table(spark, path)
    spark.createDataFrame([("7", 1), ("9", 1), (None, 1), ("x", 2)], "mac string, kind int").write.parquet(f"{folder}/list")
    allowed = spark.read.parquet(f"{folder}/list").where("kind = 1")
    kept, others = (control.allowed_senders(stored, allowed, keep) for keep in (True, False))
    assert "dynamicpruning" in plan(kept) or "dynamicPruning" in plan(kept)
    assert {r.mac for r in kept.collect()} == {"7", "9"} and kept.count() == 20
    assert others.count() == 1981 and others.where("mac is null").count() == 1


def test_bucketed_merge_has_no_exchange(spark, folder):
    base = tables.save_bucketed(inputs.users(spark, SF), "test_users", f"{folder}/users", "id", 4)
    changes = tables.save_bucketed(inputs.user_changes(spark, SF), "test_changes", f"{folder}/changes", "id", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = users.apply_changes(base, changes, ["at", "nr"])
        assert "Exchange" not in plan(merged)
        plain = users.apply_changes(inputs.users(spark, SF), inputs.user_changes(spark, SF), ["at", "nr"])
        assert sorted(map(str, merged.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
