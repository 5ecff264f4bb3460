"""Continuous ingest: landed lines to the packet table, and routing of mixed messages to their tables.

A file is read once, when it appears; receivers therefore land whole files by rename.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from csilake.operators.control import route
from csilake.operators.wire import accepted, classify_lines, data_of, rejected
from csilake.sources.landed import clean_lines


def read_line_stream(
    spark: SparkSession, path: str, folder_columns: str = "", files_per_trigger: int | None = None
) -> DataFrame:
    """Lines as they land. ``folder_columns`` is DDL for the ``name=value`` folders above the files."""
    schema = "value string" + (f", {folder_columns}" if folder_columns else "")
    reader = spark.readStream.format("text").schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def start_ingest(
    lines: DataFrame, table: str, checkpoint: str, profile: str = "strict", partition_by: list[str] | None = None,
    every: str | None = None, rejects: str | None = None, keep: list[str] | None = None, tag: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Accepted packets to ``table``, rejected lines with their reason and the columns ``keep`` to ``rejects``.

    ``tag`` adds what is known of a packet's session when its batch is stored, such as ``sessions.tag_sessions`` with a table of sessions.
    It is given the packets without ``data``.

    Each batch has folders of its own and overwrites them when it is repeated, so each line is stored exactly once.
    Without ``every`` it ends with the landed files.
    """
    decode = "mobile" if profile == "strict" else "desktop"

    def save(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        classified = classify_lines(batch, profile).drop("payload")
        if rejects is not None:  # else the batch is looked at once
            classified = classified.persist()
        try:
            packets = accepted(classified)
            outputs = [(table, packets if tag is None else _tagged(packets, tag, profile), partition_by or [])]
            if rejects is not None:
                outputs.append((rejects, rejected(classified, keep or []), []))
            for path, rows, layout in outputs:
                rows.write.mode("overwrite").partitionBy(*layout).parquet(f"{path}/batch_id={batch_id}")
        finally:
            if rejects is not None:
                classified.unpersist()

    writer = clean_lines(lines, decode).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def _tagged(packets: DataFrame, tag: Callable[[DataFrame], DataFrame], profile: str) -> DataFrame:
    """Tagging shuffles the packets, so ``data``, which ``raw`` holds too, is left out and read from it again afterwards."""
    tagged = tag(packets.drop("data"))
    added = [c for c in tagged.columns if c not in packets.columns]
    return tagged.withColumn("data", data_of(F.col("raw"), profile)).select(*packets.columns, *added)


def start_routing(messages: DataFrame, tables: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One pass over mixed messages into the tables packets, rejects, discovery, start and other.

    Each batch has folders of its own and overwrites them when it is repeated, so a restart adds nothing twice.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        routed = clean_lines(batch, "mobile").withColumn("route", route(F.col("value"))).persist()
        try:
            classified = classify_lines(routed.where("route = 'packet'").select("value"))
            outputs = {
                "packets": accepted(classified).drop("payload"),
                "rejects": rejected(classified, []),
                "messages": routed.where("route <> 'packet'").select("route", "value"),
            }
            for name, rows in outputs.items():
                rows.write.mode("overwrite").parquet(f"{tables}/{name}/batch_id={batch_id}")
        finally:
            routed.unpersist()

    writer = messages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def _triggered(writer, every: str | None):
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
