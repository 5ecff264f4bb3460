"""What a viewer shows of the stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csilake.functions import bitmaps
from csilake.functions.text import channel_text
from csilake.schema import STORED_NAMES, WIRE_NAMES


def newest_first(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows by descending id, or the first ``limit`` of them without a full sort."""
    ordered = rows.orderBy(F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def card(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "captured_at", "mac", "rssi",
        channel_text(F.col("channel"), F.col("secondary_channel")).alias("channel"),
    )


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def to_stored_names(rows: DataFrame, layout: str) -> DataFrame:
    """Canonical columns renamed to those of the desktop or mobile table."""
    return rows.withColumnsRenamed(STORED_NAMES[layout])


def to_canonical_names(rows: DataFrame, layout: str) -> DataFrame:
    return rows.withColumnsRenamed({stored: name for name, stored in STORED_NAMES[layout].items()})


def union_layouts(desktop: DataFrame, mobile: DataFrame) -> DataFrame:
    """Rows of both stored layouts under the canonical names, duplicates kept."""
    columns = ["captured_at", "scenario", *WIRE_NAMES]
    return to_canonical_names(desktop, "desktop").select(*columns).unionByName(
        to_canonical_names(mobile, "mobile").select(*columns)
    )


def summary_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums per scenario, further keys and bucket of channels, which add up: over days, files or batches."""
    return rows.groupBy("scenario", *keys, bitmaps.bucket(F.col("channel")).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.sum("rssi").alias("rssi_sum"),
        F.min("rssi").alias("rssi_min"),
        F.max("rssi").alias("rssi_max"),
        bitmaps.of_numbers(F.col("channel")).alias("channels"),
    )


def summary_of_parts(parts: DataFrame) -> DataFrame:
    """One row per scenario; its channels as a sorted list. No row is read again, only its part."""
    sums = [F.sum("n").alias("n"), F.sum("rssi_sum").alias("rssi_sum"), F.min("rssi_min").alias("rssi_min"), F.max("rssi_max").alias("rssi_max")]
    by_bucket = parts.groupBy("scenario", "bucket").agg(*sums, bitmaps.united(F.col("channels")).alias("channels"))
    listed = by_bucket.withColumn("channels", F.when(F.col("bucket").isNotNull(), bitmaps.numbers(F.col("channels"), F.col("bucket"))))
    return listed.groupBy("scenario").agg(*sums, F.array_sort(F.flatten(F.collect_list("channels"))).alias("channels"))


def scenario_summary(rows: DataFrame) -> DataFrame:
    """Count, signal range and set of channels of each scenario."""
    return summary_of_parts(summary_parts(rows))
