"""Control messages: device discovery, repeated announcements, routing by message type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csilake.functions.text import second_part
from csilake.operators.asof import last_before
from csilake.operators.ordered import SECONDS_PER_BLOCK
from csilake.operators.repeats import collapse_repeats
from csilake.schema import DISCOVERY_TAG, PACKET_TAG, START_TAG
from csilake.sources.tables import SENDER_BUCKET, sender_bucket

DISCOVERY_SECONDS = 75
DISCOVERY_WINDOW = f"{DISCOVERY_SECONDS} seconds"
ANNOUNCEMENT_GAP_SECONDS = 20


def read_announcements(log: DataFrame) -> DataFrame:
    """(device, ts, address); messages that announce nothing are skipped."""
    return log.where(F.col("msg").startswith(DISCOVERY_TAG)).select(
        "device", "ts", second_part(F.col("msg")).alias("address")
    )


def discovery_first(log: DataFrame, window: str = DISCOVERY_WINDOW) -> DataFrame:
    """First announcement of each device in each listening window."""
    return (
        read_announcements(log)
        .groupBy("device", F.window("ts", window).alias("_w"))
        .agg(F.min(F.struct("ts", "address")).alias("_first"))
        .select("device", F.col("_w.start").alias("listen_from"), "_first.ts", "_first.address")
    )


def discovery_listen(log: DataFrame, listening: DataFrame, seconds: int = DISCOVERY_SECONDS) -> DataFrame:
    """First announcement heard in each listening window, which begins when listening does and lasts ``seconds``.

    ``listening`` has listen_id, device and listen_from. A device listens to one window at a time: a later start ends the one before.
    """
    known = listening.select("listen_id", "device", "listen_from")
    end = F.col("listen_from") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    heard = last_before(read_announcements(log), known, ["device"], "ts", "listen_from", ["listen_id"])
    return (
        heard.where(F.col("ts") < end)
        .groupBy("listen_id", "device", "listen_from")
        .agg(F.min(F.struct("ts", "address")).alias("_first"))
        .select("listen_id", "device", "listen_from", "_first.ts", "_first.address")
    )


def discovery_latest(log: DataFrame) -> DataFrame:
    """Registry: the address each device announced last (the greatest text on equal times)."""
    return (
        read_announcements(log)
        .groupBy("device")
        .agg(F.max(F.struct("ts", "address")).alias("_last"))
        .select("device", F.col("_last.ts").alias("seen_at"), "_last.address")
    )


def discovery_dedup(
    log: DataFrame, gap_seconds: int = ANNOUNCEMENT_GAP_SECONDS, block_seconds: int = SECONDS_PER_BLOCK
) -> DataFrame:
    """One row per boot announcement instead of its ten repeats."""
    return collapse_repeats(read_announcements(log), ["device", "address"], "ts", gap_seconds, block_seconds)


def route(message: Column) -> Column:
    """Where a message goes: packet, discovery, start or other."""
    return (
        F.when(message.startswith(PACKET_TAG), "packet")
        .when(message.startswith(DISCOVERY_TAG), "discovery")
        .when(message.startswith(START_TAG), "start")
        .otherwise("other")
    )


def route_counts(messages: DataFrame, value: str = "value") -> DataFrame:
    return (
        messages.where(F.col(value).isNotNull())
        .groupBy(route(F.col(value)).alias("route"))
        .agg(F.count("*").alias("n"))
    )


def allowed_senders(packets: DataFrame, allowed: DataFrame, keep: bool = True) -> DataFrame:
    """Packets whose sender is on the list, or with ``keep=False`` those whose sender is not.

    Where the packets lie by sender bucket, the list's buckets are part of the key, so its join prunes folders at run time.
    """
    on = ["mac"]
    listed = allowed.select("mac").where(F.col("mac").isNotNull()).distinct()
    if SENDER_BUCKET in packets.columns:
        listed = listed.withColumn(SENDER_BUCKET, sender_bucket(F.col("mac")))
        on = [SENDER_BUCKET, "mac"]
    return packets.join(listed, on, "left_semi" if keep else "left_anti")
