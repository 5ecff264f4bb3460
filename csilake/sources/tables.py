"""Stored tables: append, replace a session, export, empty."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.session import CO_PARTITION, OPEN_FILES, OPEN_WRITERS, setting

SESSION_DATE = "session_date"
SENDER_BUCKET = "mac_bucket"
SENDER_BUCKETS = 64


def append_sessions(rows: DataFrame, path: str, gathered: bool = False) -> None:
    """Bag append; the table is created when absent. The commit is all or nothing per job.

    Rebalancing gathers each date into full files and splits a date that is too large for one task. Rows that lie in chunks along the
    date are ``gathered`` that way before, and are neither shuffled nor sorted again.
    """
    spark = rows.sparkSession
    if gathered:
        with setting(spark, OPEN_WRITERS, OPEN_FILES), setting(spark, CO_PARTITION, "false"):
            rows.write.mode("append").partitionBy(SESSION_DATE).parquet(path)
    else:
        rows.hint("rebalance", SESSION_DATE).write.mode("append").partitionBy(SESSION_DATE).parquet(path)


def sender_bucket(mac: Column) -> Column:
    """Folder of a sender: a fixed number of them, however many senders there are; a packet without one has its own."""
    return F.when(mac.isNull(), -1).otherwise(F.pmod(F.xxhash64(mac), F.lit(SENDER_BUCKETS)).cast("int"))


def append_by_sender(rows: DataFrame, path: str) -> None:
    """Append into one folder per sender bucket, so queries by sender read few of them. A large bucket is split over tasks."""
    bucketed = rows.withColumn(SENDER_BUCKET, sender_bucket(F.col("mac")))
    bucketed.hint("rebalance", SENDER_BUCKET).write.mode("append").partitionBy(SENDER_BUCKET).parquet(path)


def save_bucketed(rows: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """The rows as a table bucketed and sorted by ``key``, below ``path``; joins and aggregates on the key need no exchange of it.

    The name is the session's; the files can be registered again under any other.
    """
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def overwrite_session(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replace exactly the sessions present in ``rows``; saving twice equals saving once."""
    (
        rows.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Stored rows. Files of older layouts are merged by name, never dropped."""
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


# Quotes are doubled as in common CSV; a null is an empty cell, an empty text a quoted one.
CSV_OPTIONS = {"header": True, "escape": '"', "multiLine": True}
CSV_ROWS_PER_FILE = 1_000_000


def export_csv(rows: DataFrame, path: str) -> None:
    """A text may hold line breaks, so one file is read by one task: files are kept small instead."""
    writer = rows.write.mode("overwrite").options(**CSV_OPTIONS).option("maxRecordsPerFile", CSV_ROWS_PER_FILE)
    writer.option("emptyValue", '""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # With the default null text, the empty one, a quoted empty cell would be read as null too.
    reader = spark.read.schema(schema).options(**CSV_OPTIONS).option("enforceSchema", False)
    return reader.option("nullValue", "\0").csv(path)


def delete_all(spark: SparkSession, path: str) -> None:
    """Empty the table; its schema and its partition columns stay."""
    stored = spark.read.parquet(path)
    files = stored.select("_metadata.file_path").limit(1).collect()
    folders = re.findall(r"/([^/=]+)=[^/]*", files[0][0].removeprefix("file:")) if files else []
    layout = [c for c in stored.columns if c in folders]
    empty = spark.createDataFrame([], stored.schema)
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*layout).parquet(path)
