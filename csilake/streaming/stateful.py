"""Failure counters and the session timer over a stream.

Failure counters are Spark's state of each device, and their rows count in arrival order; batches follow the order in which files land. A
batch's rows of one device are looked at by one task. The session timer keeps no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from csilake.operators.sessions import packets_per_session, session_end

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAKS = "device bigint, max_streak bigint, hits bigint"
SESSION_STATE = "device bigint, session_id bigint, started_at timestamp_ntz, n int"


# --- failure counters -----------------------------------------------------------------------------


class FailureStreaks(StatefulProcessor):
    """Of each device the run it is in, the longest run, and the hits of runs that are over; a batch's rows count in arrival order."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "running bigint, longest bigint, closed_hits bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("arrival")
        running, longest, closed_hits = self.counters.get() if self.counters.exists() else (0, 0, 0)
        failed = events["failed"].to_numpy(dtype=bool)
        runs = np.bincount(np.cumsum(~failed), weights=failed).astype("int64")
        runs[0] += running
        longest = max(longest, int(runs.max()))
        closed_hits += int((runs[:-1] // self.threshold).sum())
        self.counters.update((int(runs[-1]), longest, closed_hits))
        hits = closed_hits + int(runs[-1]) // self.threshold
        yield pd.DataFrame({"device": pd.array([key[0]], dtype="Int64"), "max_streak": [longest], "hits": [hits]})

    def close(self) -> None:
        pass


def start_streaks(link_events: DataFrame, table: str, checkpoint: str, threshold: int, every: str | None = None) -> StreamingQuery:
    """Input: device, arrival, failed. Spark keeps the counters; each batch writes those it changed to a folder that its repeat overwrites."""
    link_events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    changed = link_events.groupBy("device").transformWithStateInPandas(FailureStreaks(threshold), STREAKS, "Update", "None")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    writer = changed.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def streaks_so_far(spark: SparkSession, table: str) -> DataFrame:
    """(device, max_streak, hits): what each device's last batch wrote."""
    written = spark.read.schema(f"{STREAKS}, batch_id bigint").parquet(table)
    last = written.groupBy("device").agg(F.max_by(F.struct("max_streak", "hits"), "batch_id").alias("_last"))
    return last.select("device", "_last.*")


# --- session timer --------------------------------------------------------------------------------


def open_sessions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sessions devices really run: a start is heard only when the session before it has ended.

    Rows come sorted by device and time, so one end time is all that is remembered, however many starts
    a device sends.
    """
    current, ends = None, 0
    for starts in batches:
        at = starts["ts"].to_numpy(dtype="datetime64[us]").astype("int64")
        until = at + starts["n"].to_numpy(dtype="int64") * 1_000_000
        heard = np.zeros(len(starts), dtype=bool)
        for row, device in enumerate(starts["device"].to_numpy()):
            if device != current or at[row] >= ends:
                current, ends, heard[row] = device, until[row], True
        yield starts.loc[heard, ["device", "session_id", "ts", "n"]].rename(columns={"ts": "started_at"})


def start_session_timer(messages: DataFrame, state: str, counts: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Input: device, ts, is_packet, and for start commands session_id and n (seconds).

    Each batch stores its start commands in ``state`` and its packets, counted per device and instant, in ``counts``. Which
    starts were heard follows from all of them, so a packet or a start that lands late counts as if in time.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        starts = batch.where(~F.col("is_packet") & (F.col("n") > 0)).groupBy("device", "ts").agg(F.min(F.struct("session_id", "n")).alias("first"))
        starts.select("device", "ts", "first.*").write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        packets = batch.where("is_packet").groupBy("device", "ts").agg(F.count("*").alias("packets"))
        packets.write.mode("overwrite").parquet(f"{counts}/batch_id={batch_id}")

    writer = messages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def sessions_so_far(spark: SparkSession, state: str, counts: str) -> DataFrame:
    """(session_id, device, started_at, ends_at, packets) of every session of the stream.

    Only start commands, one per device and instant, are scanned in order per device; packets are counted in time blocks.
    """
    first = spark.read.parquet(state).groupBy("device", "ts").agg(F.min(F.struct("session_id", "n")).alias("first"))
    ordered = first.select("device", "ts", "first.*").repartition("device").sortWithinPartitions("device", "ts")
    sessions = ordered.mapInPandas(open_sessions, SESSION_STATE)
    packets = packets_per_session(spark.read.parquet(counts), sessions, weight=F.col("packets"))
    return sessions.join(packets.select("session_id", "packets"), "session_id", "left").select(
        "session_id", "device", "started_at", session_end(F.col("started_at"), F.col("n")).alias("ends_at"),
        F.coalesce("packets", F.lit(0)).alias("packets"),
    )
