"""Streams with Spark's own state: sessions that end as time passes, packets joined to their session, packets once.

Here Spark keeps the state and drops what the watermark has passed, so state is bounded by the time a device may be late, and a
row that comes later than that is dropped and counted in the query's progress (``rows_dropped``). Where lateness can't be bounded, the
forms that store sums of each batch (``stateful``, ``windows``) answer from all rows ever landed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from csilake.operators.sessions import session_end
from csilake.streaming.stateful import STATE_STORE

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ENDED = "session_id bigint, device bigint, started_at timestamp, ends_at timestamp, packets bigint"


def rows_dropped(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress that the query remembers."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])


def _started(writer, checkpoint: str, path: str, every: str | None) -> StreamingQuery:
    """Rows are appended by the file sink, whose log makes each batch count once."""
    writer = writer.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


class SessionEnds(StatefulProcessor):
    """Of each device the session that runs: a start is heard only when none does. A session's end writes its row.

    It ends at the device's next message at or after its end, or when the watermark gets there. Messages of a device come in time
    order from batch to batch; inside a batch they are sorted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "session_id bigint, started bigint, ends bigint, packets bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        packets, starts, last = [], [], None
        for row in rows:
            at = row.at
            last = at if last is None or at is not None and at > last else last
            if at is None:
                continue
            if row.is_packet:
                packets.append(at)
            elif row.n is not None and row.n > 0:
                starts.append((at, row.session_id, row.n))
        packets.sort()
        starts.sort()
        before = self.running.get()
        running, ended = before, []

        def counted(session: tuple) -> tuple:
            number, start, ends, n = session
            return number, start, ends, n + bisect_left(packets, ends) - bisect_left(packets, start)

        for start, number, seconds in starts:
            if running is None or start >= running[2]:
                if running is not None:
                    ended.append(counted(running))
                running = (number, start, start + seconds * 1_000_000, 0)
        if running is not None:
            running = counted(running)
            if last is not None and last >= running[2]:
                ended.append(running)
                running = None
        # each call to the state is a message to Spark, so a device whose state stays as it was makes none
        if running != before:
            timers = [None if session is None else _millis(session[2]) for session in (before, running)]
            if timers[0] != timers[1]:
                if before is not None:
                    self.handle.deleteTimer(timers[0])
                if running is not None:
                    self.handle.registerTimer(timers[1])
            if running is None:
                self.running.clear()
            else:
                self.running.update(running)
        for session in ended:
            yield _ended(key[0], session)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        running = self.running.get()
        if running is not None and _millis(running[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.running.clear()
            yield _ended(key[0], running)

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first millisecond at or after."""
    return -(-int(micros) // 1000)


def _ended(device: int, session: tuple) -> Row:
    number, start, ends, packets = session
    return Row(session_id=number, device=device, started_at=_EPOCH + timedelta(microseconds=start), ends_at=_EPOCH + timedelta(microseconds=ends), packets=packets)


def start_session_ends(messages: DataFrame, path: str, checkpoint: str, late: str = "0 seconds", every: str | None = None) -> StreamingQuery:
    """Input: device, ts, is_packet, and for start commands session_id and n (seconds). One row per session, when it ends.

    A device's messages of one batch are looked at by one task; ``stateful.start_session_timer`` counts them in blocks instead.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    dated = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # rows reach Python as rows: a device has few of them in a batch, and a table for each would cost more than they do
    timed = dated.select("device", "ts", F.unix_micros("ts").alias("at"), "is_packet", "session_id", "n")
    ended = timed.groupBy("device").transformWithState(SessionEnds(), ENDED, "Append", "EventTime")
    return _started(ended.writeStream, checkpoint, path, every)


def start_session_packets(
    packets: DataFrame, sessions: DataFrame, path: str, checkpoint: str, longest: str = "3 hours", late: str = "0 seconds", every: str | None = None
) -> StreamingQuery:
    """Packets (arrival, device, ts) of the device's sessions (device, session_id, started_at, n), as both streams land.

    Both sides wait for each other no longer than ``longest``, which bounds a session's length, and ``late``; sessions that state a longer one are
    cut to it. State holds that much of either stream.
    """
    left = packets.select("arrival", "device", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    began = F.col("started_at").cast("timestamp")
    right = sessions.select(F.col("device").alias("_device"), "session_id", began.alias("_began"), session_end(began, F.col("n")).alias("_ends")).withWatermark("_began", late)
    span = F.expr(f"interval {longest}")
    together = (F.col("device") == F.col("_device")) & (F.col("ts") >= F.col("_began")) & (F.col("ts") < F.col("_began") + span)
    joined = left.join(right, together & (F.col("ts") < F.col("_ends"))).select("arrival", "device", "ts", "session_id")
    return _started(joined.writeStream, checkpoint, path, every)


def start_packets_once(packets: DataFrame, keys: list[str], path: str, checkpoint: str, late: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """Packets (with ``ts``) whose keys were not seen within ``late``: a file landed again, or a datagram sent twice, adds nothing."""
    dated = packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return _started(dated.dropDuplicatesWithinWatermark(keys).writeStream, checkpoint, path, every)
