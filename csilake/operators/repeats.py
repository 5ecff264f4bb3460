"""Collapse messages that a sender repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csilake.operators.ordered import SECONDS_PER_BLOCK, previous_value, running_total, time_block


def collapse_repeats(
    messages: DataFrame, keys: list[str], ts: str, gap_seconds: int, block_seconds: int = SECONDS_PER_BLOCK, copies: Column | None = None
) -> DataFrame:
    """(keys, first_ts, last_ts, copies): one row per run of equal messages.

    A message more than ``gap_seconds`` after the one before it starts a new run. ``copies`` is how many messages a row
    stands for, one by default.
    """
    block = time_block(ts, block_seconds)
    # Copies at the same instant are counted first, so (keys, ts) is unique in the ordered steps.
    instants = messages.groupBy(*keys, ts).agg((F.count("*") if copies is None else F.sum(copies)).alias("_copies"))
    stepped = previous_value(instants, keys, [ts], block, ts, "_previous")
    limit = F.col("_previous") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds))
    starts = F.when(F.col("_previous").isNull() | (F.col(ts) > limit), 1).otherwise(0)
    runs = running_total(stepped, keys, [ts], block, starts, "_run")
    return (
        runs.groupBy(*keys, "_run")
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.sum("_copies").alias("copies"))
        .drop("_run")
    )
