"""Last fact before each row: an as-of join that stays parallel inside one key.

Rows and facts go into one time order per key, a fact before a row of its instant. The last fact so far is found inside blocks of that
order; what a block begins with comes from one small row per non-empty block. No row meets a fact, and a key
that holds a large share of the rows is still many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csilake.operators.ordered import SECONDS_PER_BLOCK, _per_block, time_block


def last_before(
    rows: DataFrame, facts: DataFrame, keys: list[str], at: str, since: str, tie: list[str] | None = None,
    block_seconds: int = SECONDS_PER_BLOCK, within: Column | None = None,
) -> DataFrame:
    """Adds the columns of the last fact of the row's key with ``since <= at``; nulls where there is none.

    ``rows`` have ``keys`` and ``at``, ``facts`` have ``keys`` and ``since``; their other columns must differ. Of facts of one instant
    the greatest by ``tie`` is the last. ``within`` is a condition on the joined columns that a fact must meet to be kept, such as an age.
    Rows with a null key or time are kept without a fact, facts with one are never met.
    """
    tie = tie or []
    added = [c for c in facts.columns if c not in keys]
    clash = set(added) & set(rows.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    known = facts.where(F.col(since).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    key_columns = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(keys))]
    fact = F.struct(F.col(since).alias("_since"), *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)), F.struct(*added).alias("_fact"))
    right = known.select(*key_columns, F.col(since).alias("_at"), F.lit(0).alias("_side"), fact.alias("_known"))
    right = right.withColumn("_row", F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType))
    left = rows.select(
        *key_columns, F.col(at).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(right.schema["_known"].dataType).alias("_known"), F.struct(*rows.columns).alias("_row"),
    )
    both = left.unionByName(right).withColumn("_block", time_block("_at", block_seconds))
    # a struct's order is that of its fields: the instant, then the ties
    order = ["_at", "_side", *(F.col(f"_known._tie{i}") for i in range(len(tie)))]
    inside = Window.partitionBy(*names, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = [F.col(f"_known._tie{i}").alias(f"t{i}") for i in range(len(tie))]
    ends = both.groupBy(*names, "_block").agg(F.max_by("_known", F.when(F.col("_side") == 0, F.struct(F.col("_at").alias("a"), *ties))).alias("_end"))
    before = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*names, "_block", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    scanned = both.withColumn("_inside", F.last("_known", ignorenulls=True).over(inside)).where("_side = 1")
    found = _per_block(scanned, carried, names).select("_row", F.coalesce("_inside", "_before")["_fact"].alias("_fact"))
    joined = found.select("_row.*", "_fact.*")
    if within is None:
        return joined
    return joined.withColumn("_kept", F.coalesce(within, F.lit(False))).select(
        *rows.columns, *(F.when(F.col("_kept"), F.col(c)).alias(c) for c in added)
    )
