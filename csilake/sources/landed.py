"""Landed text: one message per line, written by the receivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.functions.text import decode_line
from csilake.operators.wire import has_prefix
from csilake.session import OPEN_FILES, OPEN_WRITERS, setting

#: Folders that a task writes into side by side. A task with rows for more sorts the rest of them by folder.
OPEN_FOLDERS = OPEN_FILES
#: Lines of a compressed file at most: one task reads it, since it can't be cut.
LINES_PER_FILE = 1 << 18


def land_lines(lines: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None, sender: str | None = None) -> None:
    """Write ``value`` as text files, e.g. a stored table rendered back to a replay log.

    Lines are not sorted by folder first, so they neither fill a task's memory nor go to disk twice. With ``sender``, each line
    stands behind that column's text, empty for a null, and a tab, as its receiver knows whom it came from. ``read_lines`` reads files
    of any ``compression``.
    """
    by = partition_by or []
    options = {} if compression is None else {"maxRecordsPerFile": LINES_PER_FILE, "zlib.compress.level": "BEST_SPEED"}
    value = F.col("value")
    if sender is not None:
        value = F.concat(F.coalesce(F.col(sender).cast("string"), F.lit("")), F.lit("\t"), F.coalesce(value, F.lit(""))).alias("value")
    with setting(lines.sparkSession, OPEN_WRITERS, OPEN_FOLDERS):
        writer = lines.select(*by, value).write.mode("append").partitionBy(*by).options(**options)
        writer.text(path, compression=compression)


def read_lines(spark: SparkSession, path: str, sender: str | None = None) -> DataFrame:
    """Lines with the folder columns, and where each one stood; with ``sender``, what stood before the tab in a column of that name.

    Inside one (``file``, ``file_block``) the line order is that of ``line``.
    """
    lines = spark.read.text(path).select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("file_block"),
        F.monotonically_increasing_id().alias("line"),
    )
    if sender is None:
        return lines
    tab = F.instr("value", "\t")
    return lines.withColumns({sender: F.substring("value", F.lit(1), tab - 1), "value": F.substr("value", tab + 1)})


def clean_lines(lines: DataFrame, profile: str, value: str = "value") -> DataFrame:
    """Decoded and trimmed text instead of raw bytes; null records are dropped."""
    return lines.where(F.col(value).isNotNull()).withColumn(value, decode_line(F.col(value), profile))


def ingest_lines(lines: DataFrame, profile: str = "desktop", value: str = "value") -> DataFrame:
    """Packet lines only, cleaned."""
    return clean_lines(lines, profile, value).where(has_prefix(F.col(value)))
