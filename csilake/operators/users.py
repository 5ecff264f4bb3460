"""The user dimension: validate, apply a change log, report, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csilake.functions.text import MOBILE_SPACE, is_blank, status_label


def validate(users: DataFrame, required: tuple[str, ...] = ("nome", "apelido")) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): required fields are trimmed, and a row with a blank one is rejected."""
    blank = F.lit(False)
    for name in required:
        blank = blank | is_blank(F.col(name))
    valid = users.where(~blank).withColumns({name: F.btrim(F.col(name), F.lit(MOBILE_SPACE)) for name in required})
    missing = F.concat_ws(",", *[F.when(is_blank(F.col(name)), F.lit(name)) for name in required])
    return valid, users.where(blank).withColumn("missing", missing)


def _existence(base: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Per changed id: when it came to exist, when it was deleted, and its last state.

    Everything is a mergeable aggregate, so a much-changed id is combined before the shuffle.
    """
    at = F.struct(*order)
    state = F.struct("nome", "apelido", "status")
    per_id = changes.groupBy("id").agg(
        F.min(F.when(F.col("op") == "I", at)).alias("inserted_at"),
        F.max(F.when(F.col("op").isin("I", "U"), F.struct(at.alias("at"), state.alias("state")))).alias("last"),
        F.min(F.when(F.col("op") == "D", at)).alias("first_delete"),
        F.max(F.when(F.col("op") == "D", at)).alias("last_delete"),
    )
    return base.join(per_id, "id", "full_outer")


def apply_changes(base: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Snapshot after a log of I, U and D rows in ``order``.

    Ids are never used again, so a delete is final whatever follows it. The last insert or update
    wins otherwise. Updates and deletes of an id that does not exist yet change nothing.
    """
    known = base.withColumn("_known", F.lit(True))
    joined = _existence(known, changes, order)
    born_known = F.coalesce(F.col("_known"), F.lit(False))
    exists = born_known | F.col("inserted_at").isNotNull()
    deleted = F.when(born_known, F.col("last_delete").isNotNull()).otherwise(
        F.coalesce(F.col("last_delete") > F.col("inserted_at"), F.lit(False))
    )
    changed = F.col("last").isNotNull()

    def pick(name: str) -> Column:
        return F.when(changed, F.col(f"last.state.{name}")).otherwise(F.col(name)).alias(name)

    return joined.where(exists & ~deleted).select("id", pick("nome"), pick("apelido"), pick("status"))


def change_report(base: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """(op, applied, unmatched): how many changes met an existing row.

    An update or delete is unmatched when its id is unknown or already deleted at that point.
    """
    at = F.struct(*order)
    inserted = changes.groupBy("id").agg(F.min(F.when(F.col("op") == "I", at)).alias("_born"))
    known = base.select("id").withColumn("_known", F.lit(True))
    lifetimes = inserted.join(known, "id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    born = changes.join(lifetimes, "id").withColumn(
        "_alive_from", F.col("_known") | F.coalesce(at >= F.col("_born"), F.lit(False))
    )
    first_delete = born.groupBy("id").agg(
        F.min(F.when((F.col("op") == "D") & F.col("_alive_from"), at)).alias("_died")
    )
    judged = born.join(first_delete, "id")
    met = F.col("_alive_from") & (F.col("_died").isNull() | (at <= F.col("_died")))
    return judged.groupBy("op").agg(
        F.count_if(met).alias("applied"), F.count_if(~met).alias("unmatched")
    )


def label(users: DataFrame) -> DataFrame:
    return users.select("id", "nome", status_label(F.col("status")).alias("status_label"))


def count(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("n"), (F.count("*") == 0).alias("is_empty"))
