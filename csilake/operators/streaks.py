"""Consecutive connection failures per device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csilake.operators.ordered import ROWS_PER_BLOCK, arrival_block, running_total

THRESHOLD = 15


def failure_runs(link_events: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(device, run, failures): disconnects between one connect and the next, in arrival order.

    Input columns: device, arrival, failed (true for a disconnect, false for a connect).
    """
    connects = running_total(
        link_events, ["device"], ["arrival"], arrival_block("arrival", rows_per_block),
        F.when(F.col("failed"), 0).otherwise(1), "run",
    )
    return connects.groupBy("device", "run").agg(F.count_if(F.col("failed")).alias("failures"))


def failure_streaks(
    link_events: DataFrame, threshold: int = THRESHOLD, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """(device, max_streak, hits).

    Reaching the threshold resets the device, so its counter starts again from 0: a run of
    failures hits once per full threshold. ``max_streak`` is the longest run in the log.
    """
    return (
        failure_runs(link_events, rows_per_block)
        .groupBy("device")
        .agg(
            F.max("failures").alias("max_streak"),
            F.sum(hits_in_run(F.col("failures"), threshold)).alias("hits"),
        )
    )


def hits_in_run(failures: Column, threshold: int) -> Column:
    return F.floor(failures / F.lit(threshold)).cast("bigint")
