"""Payload values and packet timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csilake.functions.payload import pair_magnitudes
from csilake.operators.ordered import ROWS_PER_BLOCK, arrival_block, previous_value
from csilake.schema import CLOCK_MODULUS, NOMINAL_INTERVAL_MICROS


def payload_long(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per payload value, index from 0."""
    return rows.select(*keep, F.posexplode("payload").alias("idx", "value"))


def payload_integrity(rows: DataFrame) -> DataFrame:
    """Rows whose payload is unreadable or not as long as the record says."""
    return rows.where(F.col("payload").isNull() | (F.size("payload") != F.col("len")))


def magnitude_long(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per value pair with its magnitude."""
    pairs = F.explode(pair_magnitudes(F.col("payload"), F.col("first_word"))).alias("_p")
    return rows.select(*keep, pairs).select(*keep, "_p.pair", "_p.magnitude")


def seq_gaps(packets: DataFrame, session: list[str], arrival: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per session: packets, numbers skipped, repeats and backward steps between neighbours."""
    stepped = previous_value(
        packets.select(*session, arrival, "seq"), session, [arrival], arrival_block(arrival, rows_per_block), "seq", "_prev"
    )
    step = F.col("seq").cast("bigint") - F.col("_prev")
    return stepped.groupBy(*session).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(step > 1, step - 1)), F.lit(0)).cast("bigint").alias("missing"),
        F.count_if(step == 0).alias("repeated"),
        F.count_if(step < 0).alias("backward"),
    )


def clock_step(now: Column, before: Column) -> Column:
    """Ticks between two readings of the 32-bit device clock, which wraps."""
    return F.pmod(now - before, F.lit(CLOCK_MODULUS))


def interarrival(packets: DataFrame, session: list[str], arrival: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per session: packet spacing in device ticks against the nominal spacing."""
    stepped = previous_value(
        packets.select(*session, arrival, "local_timestamp"),
        session, [arrival], arrival_block(arrival, rows_per_block), "local_timestamp", "_prev",
    )
    step = clock_step(F.col("local_timestamp"), F.col("_prev"))
    return (
        stepped.withColumn("_step", step)
        .where(F.col("_step").isNotNull())
        .groupBy(*session)
        .agg(
            F.count("*").alias("steps"),
            F.min("_step").alias("min_step"),
            F.max("_step").alias("max_step"),
            F.sum("_step").alias("total_step"),
            F.count_if(F.col("_step") > NOMINAL_INTERVAL_MICROS).alias("late"),
        )
    )
