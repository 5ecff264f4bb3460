"""Streaming forms of progress counts and announcement dedup.

Each batch stores its rows summed up under a folder of its own, which a repeated batch overwrites. Sums of sums
don't depend on where batches were cut or how late a row came, so nothing is dropped and no state is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from csilake.operators.control import read_announcements
from csilake.operators.repeats import collapse_repeats


def start_sums(
    rows: DataFrame, table: str, checkpoint: str, summed: Callable[[DataFrame], DataFrame], every: str | None = None
) -> StreamingQuery:
    """``summed`` of each batch to the table. Without ``every`` it ends with the landed files."""

    def save(batch: DataFrame, batch_id: int) -> None:
        summed(batch).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def start_progress(
    packets: DataFrame, table: str, checkpoint: str, session: list[str], period: str = "5 seconds", every: str | None = None
) -> StreamingQuery:
    """Packets per session and period, as each batch adds them."""

    def summed(batch: DataFrame) -> DataFrame:
        ticks = batch.groupBy(*session, F.window("ts", period).alias("_w")).agg(F.count("*").alias("packets"))
        return ticks.select(*session, F.col("_w.end").cast("timestamp_ntz").alias("tick"), "packets")

    return start_sums(packets, table, checkpoint, summed, every)


def progress_so_far(spark: SparkSession, table: str, session: list[str]) -> DataFrame:
    return spark.read.parquet(table).groupBy(*session, "tick").agg(F.sum("packets").alias("packets"))


def start_announcements(log: DataFrame, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """(device, address, ts, copies) as each batch adds them."""

    def summed(batch: DataFrame) -> DataFrame:
        return read_announcements(batch).groupBy("device", "address", "ts").agg(F.count("*").alias("copies"))

    return start_sums(log, table, checkpoint, summed, every)


def announcements_so_far(spark: SparkSession, table: str, gap_seconds: int) -> DataFrame:
    """(device, address, first_ts, last_ts, copies): one row per run of repeats, whichever batches they came in."""
    return collapse_repeats(spark.read.parquet(table), ["device", "address"], "ts", gap_seconds, copies=F.col("copies"))
