"""Tables whose rows carry an id that goes on over appends, clustered by it, and pages of them from the newest on.

The next id follows from the greatest stored one, which parquet keeps in its footers: no data page is read for it. Each append
writes files of narrow id ranges, so a page of the newest rows reads the last of them alone. One writer appends at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.operators.sessions import number_rows

ROWS_PER_FILE = 1_000_000


def greatest_id(spark: SparkSession, path: str) -> DataFrame:
    """One row with the greatest stored id, from the footers: the aggregate is pushed into the scan."""
    reading = spark.newSession()  # its settings are its own
    reading.conf.set("spark.sql.sources.useV1SourceList", "")
    reading.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return reading.read.parquet(path).agg(F.max("id").alias("id"))


def high_water(spark: SparkSession, path: str) -> int:
    """The greatest id of the table, 0 if it has no rows or isn't there."""
    try:
        return greatest_id(spark, path).head()[0] or 0
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0


def append_numbered(rows: DataFrame, path: str, order: list[str], rows_per_file: int = ROWS_PER_FILE) -> int:
    """Append under the next ids, in ``order``; gives the first of them."""
    first = high_water(rows.sparkSession, path) + 1
    numbered = number_rows(rows, order, "id", first)
    ranged = numbered.repartitionByRange("id").sortWithinPartitions("id")
    ranged.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return first


def page(spark: SparkSession, path: str, size: int, before: int | None = None) -> DataFrame:
    """The ``size`` rows of the greatest ids below ``before``, greatest first.

    Ids are dense but for deleted rows, so a range of ``size`` ids is looked at first and one four times as wide as long as that
    holds too few; the range is a filter on file and row group statistics.
    """
    stored = spark.read.parquet(path)
    high = high_water(spark, path) if before is None else before - 1
    span = size
    while True:
        low = high - span + 1
        found = stored.where(F.col("id").between(low, high))
        if low <= 1 or found.count() >= size:
            return found.orderBy(F.desc("id")).limit(size)
        span *= 4
