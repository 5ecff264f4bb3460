"""Ordered operators that stay parallel inside one key.

A plain window sends each key to one task, so a device or session that holds a large share of the
rows becomes one endless task. Here rows are cut into *blocks* along the order, each (key, block) is
scanned on its own, and a second pass over one row per block supplies what came before it. Blocks of
one key run in parallel; the second pass sees one small row per non-empty block.

Rows with a null key form a key of their own, rows with a null order come first; none are dropped. ``block`` must
not decrease along the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1 << 20
SECONDS_PER_BLOCK = 60


def arrival_block(arrival: str, rows: int = ROWS_PER_BLOCK) -> Column:
    """Block of a dense arrival number: holds at most ``rows`` rows."""
    return F.floor(F.col(arrival) / F.lit(rows)).cast("bigint")


def time_block(ts: str, seconds: int = SECONDS_PER_BLOCK) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def _per_block(rows: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Joins what is known per (key, block), nulls being equal."""
    names = [*keys, "_block"]
    other = added.withColumnsRenamed({name: f"_of_{name}" for name in names})
    return rows.join(other, [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in names])


def running_total(
    df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the key up to and including this one."""
    rows = df.withColumn("_block", block).withColumn("_value", value.cast("bigint"))
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    along = Window.partitionBy(*keys).orderBy("_block")
    prior = totals.select(*keys, "_block", (F.sum("_total").over(along) - F.col("_total")).alias("_prior"))
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _per_block(rows.withColumn("_inside", F.sum("_value").over(inside)), prior, keys)
        .select(*df.columns, (F.col("_prior") + F.col("_inside")).alias(out))
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[str], block: Column, out: str) -> DataFrame:
    """Adds ``out``: position in the key's order, from 0."""
    numbered = running_total(df, keys, order, block, F.lit(1), out)
    return numbered.withColumn(out, F.col(out) - 1)


def previous_value(df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the row before this one in the key's order; null on the first row."""
    rows = df.withColumn("_block", block)
    # A single number as position keeps this a hash aggregate.
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    ends = rows.groupBy(*keys, "_block").agg(F.max_by(value, position).alias("_end"))
    along = Window.partitionBy(*keys).orderBy("_block")
    before = ends.select(*keys, "_block", F.lag("_end").over(along).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    lagged = rows.withColumn("_lag", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    return (
        _per_block(lagged, before, keys)
        .select(*df.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")).alias(out))
    )
