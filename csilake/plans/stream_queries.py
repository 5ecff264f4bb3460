"""Queries that run a stream to the end of its landed files and return what it stored."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from csilake.operators import control, sessions
from csilake.plans import inputs
from csilake.plans.queries import PROGRESS_PERIOD, SESSION, STREAK_THRESHOLD, messages, query
from csilake.schema import WIRE_NAMES
from csilake.session import new_folder, setting
from csilake.sources import landed
from csilake.sources.collector_sqlite import mounted
from csilake.sources.datagrams import DatagramLog
from csilake.streaming import ingest, stateful, timed, windows


BATCHES = 3
#: Writes a query's logs through Hadoop's FileSystem. On mounted folders the default also looks for the file and then renames, but starts processes for that
#: where Hadoop has no native library, which is most of what a small batch's logs cost.
LOG_FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def _parts(rows, order):
    """The rows in BATCHES parts along ``order``, as they would land one after the other."""
    at = F.col(order).cast("bigint") if dict(rows.dtypes)[order] != "timestamp_ntz" else F.unix_micros(F.col(order).cast("timestamp"))
    low, high = rows.select(F.min(at), F.max(at)).first()
    width = ((high or 0) - (low or 0)) // BATCHES + 1
    return [rows.where(F.coalesce(F.floor((at - (low or 0)) / width), F.lit(0)) == k) for k in range(BATCHES)]


def _run(spark, rows, order, start):
    """Lands the parts and runs the stream to its end after each: one batch or more per part."""
    path = new_folder(spark, "landed")
    for part in _parts(rows, order):
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(part.schema).parquet(path)).awaitTermination()


def _run_lines(spark, rows, order, start, columns=()):
    path = new_folder(spark, "landed")
    for part in _parts(rows, order):
        landed.land_lines(part, path, list(columns))
        start(ingest.read_line_stream(spark, path, ", ".join(f"{c} string" for c in columns))).awaitTermination()


def _ingested(spark, sf_dir):
    table, rejects, checkpoint = (new_folder(spark, x) for x in ("packets", "rejects", "checkpoint"))
    _run_lines(
        spark, inputs.csi_lines(spark, sf_dir), "event_id",
        lambda lines: ingest.start_ingest(lines, table, checkpoint, partition_by=["scenario"], rejects=rejects, keep=["scenario"]), ["scenario"],
    )
    return spark.read.parquet(table), spark.read.parquet(rejects)


@query
def stream_ingest(spark, sf_dir):
    return _ingested(spark, sf_dir)[0].select("scenario", *WIRE_NAMES)


@query
def stream_pipeline(spark, sf_dir):
    """Landed lines to packets with the stamp, scenario and id of their session, as they land; rows per session."""
    table, checkpoint = new_folder(spark, "packets"), new_folder(spark, "checkpoint")
    tags = inputs.session_table(spark, sf_dir).withColumn("mac", inputs.device_mac(F.col("device")))
    tag = lambda rows: sessions.tag_sessions(rows, tags, ["session_date", "mac"])
    _run_lines(
        spark, inputs.csi_lines(spark, sf_dir), "event_id",
        lambda lines: ingest.start_ingest(lines.withColumn("session_date", F.col("session_date").cast("date")), table, checkpoint, tag=tag), ["session_date"],
    )
    return spark.read.parquet(table).groupBy("session_id", "captured_at", "scenario").agg(F.count("*").alias("n"))


@query
def stream_reject_counts(spark, sf_dir):
    """What the stream rejected, by reason."""
    return _ingested(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query
def stream_route_counts(spark, sf_dir):
    stored, checkpoint = new_folder(spark, "routed"), new_folder(spark, "checkpoint")
    rows = messages(spark, sf_dir).withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(BATCHES)))
    path = new_folder(spark, "landed")
    for part in range(BATCHES):
        landed.land_lines(rows.where(F.col("_part") == part).drop("_part"), path)
        ingest.start_routing(ingest.read_line_stream(spark, path), stored, checkpoint).awaitTermination()
    kept = spark.read.parquet(f"{stored}/packets").select(F.lit("packet").alias("route"))
    bad = spark.read.parquet(f"{stored}/rejects").select(F.lit("reject").alias("route"))
    other = spark.read.parquet(f"{stored}/messages").select("route")
    return kept.unionByName(bad).unionByName(other).groupBy("route").agg(F.count("*").alias("n"))


@query
def stream_progress(spark, sf_dir):
    table, checkpoint = new_folder(spark, "progress"), new_folder(spark, "checkpoint")
    start = lambda packets: windows.start_progress(packets, table, checkpoint, SESSION, PROGRESS_PERIOD)
    _run(spark, inputs.packet_times(spark, sf_dir), "arrival", start)
    so_far = Window.partitionBy(*SESSION).orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return windows.progress_so_far(spark, table, SESSION).withColumn("in_buffer", F.sum("packets").over(so_far))


@query
def stream_discovery_dedup(spark, sf_dir):
    table, checkpoint = new_folder(spark, "announcements"), new_folder(spark, "checkpoint")
    _run(spark, inputs.discovery_log(spark, sf_dir), "ts", lambda log: windows.start_announcements(log, table, checkpoint))
    return windows.announcements_so_far(spark, table, control.ANNOUNCEMENT_GAP_SECONDS)


@query
def stream_failure_streaks(spark, sf_dir):
    state, checkpoint = new_folder(spark, "streaks"), new_folder(spark, "checkpoint")
    start = lambda events: stateful.start_streaks(events, state, checkpoint, STREAK_THRESHOLD)
    _run(spark, inputs.link_events(spark, sf_dir), "arrival", start)
    return stateful.streaks_so_far(spark, state).withColumnRenamed("device", "user_id")


@query
def stream_session_timer(spark, sf_dir):
    """Sessions that each device really ran, one at a time, with the packets in them."""
    starts = sessions.read_starts(inputs.start_commands(spark, sf_dir))
    marks = starts.select("device", "ts", F.lit(False).alias("is_packet"), "session_id", "n")
    packets = inputs.packet_times(spark, sf_dir).select(
        "device", "ts", F.lit(True).alias("is_packet"), F.lit(None).cast("bigint").alias("session_id"), F.lit(None).cast("int").alias("n")
    )
    state, counts, checkpoint = (new_folder(spark, x) for x in ("timed", "timed-packets", "checkpoint"))
    start = lambda rows: stateful.start_session_timer(rows, state, counts, checkpoint)
    _run(spark, packets.unionByName(marks), "ts", start)
    return stateful.sessions_so_far(spark, state, counts)


def _marks(spark, sf_dir):
    """Start commands and packets as one stream of messages."""
    starts = sessions.read_starts(inputs.start_commands(spark, sf_dir)).select("device", "ts", F.lit(False).alias("is_packet"), "session_id", "n")
    packets = inputs.packet_times(spark, sf_dir).select("device", "ts", F.lit(True).alias("is_packet"))
    return packets.unionByName(starts, allowMissingColumns=True)


@query
def stream_session_ends(spark, sf_dir):
    """A row for each session that had ended by the time of the last message."""
    path, checkpoint = new_folder(spark, "ended"), new_folder(spark, "checkpoint")
    _run(spark, _marks(spark, sf_dir), "ts", lambda rows: timed.start_session_ends(rows, path, checkpoint))
    return spark.read.parquet(path).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ends_at")})


@query
def stream_session_packets(spark, sf_dir):
    """Two streams, packets and start commands, land in three parts each."""
    out, checkpoint, packet_path, start_path = (new_folder(spark, x) for x in ("joined", "checkpoint", "landed", "landed"))
    packets = inputs.packet_times(spark, sf_dir).select("arrival", "device", "ts")
    starts = sessions.read_starts(inputs.start_commands(spark, sf_dir)).where("n > 0").select("session_id", "device", F.col("ts").alias("started_at"), "n")
    bounds = packets.select(F.min("ts"), F.max("ts")).first()
    if bounds[0] is None:
        return packets.withColumn("session_id", F.lit(None).cast("bigint"))
    step = (bounds[1] - bounds[0]) / BATCHES
    for k in range(BATCHES):
        low, high = bounds[0] + k * step, bounds[0] + (k + 1) * step
        within = lambda c: (F.col(c) >= F.lit(low)) & ((F.col(c) < F.lit(high)) | F.lit(k == BATCHES - 1))  # noqa: B023, E731
        packets.where(within("ts")).write.mode("append").parquet(packet_path)
        starts.where(within("started_at")).write.mode("append").parquet(start_path)
        read = [spark.readStream.schema(x.schema).parquet(p) for x, p in ((packets, packet_path), (starts, start_path))]
        timed.start_session_packets(*read, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def stream_packets_once(spark, sf_dir):
    """Each part lands, and then some of its files again."""
    out, checkpoint, path = (new_folder(spark, x) for x in ("once", "checkpoint", "landed"))
    packets = inputs.packet_times(spark, sf_dir).withColumn("seq", F.col("arrival") % 100_000)
    for part in _parts(packets, "ts"):
        for landing in (part, part.where("arrival % 5 < 2")):
            landing.write.mode("append").parquet(path)
            rows = spark.readStream.schema(packets.schema).parquet(path)
            timed.start_packets_once(rows, [*SESSION, "seq"], out, checkpoint, "60 days").awaitTermination()
    return spark.read.parquet(out).select("arrival", *SESSION, "seq", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query
def stream_datagrams(spark, sf_dir):
    """Lines logged as binary datagrams, in three landings, each read in limited batches of byte ranges by a query started anew."""
    path, out, checkpoint, state = (mounted(new_folder(spark, x)) for x in ("logs", "received", "checkpoint", "log-state"))
    spark.dataSource.register(DatagramLog)
    lines = inputs.csi_lines(spark, sf_dir).select("event_id", F.col("ts").alias("arrived"), F.encode(F.concat(F.col("event_id").cast("string"), F.lit(" "), "value"), "UTF-8").alias("value"))
    for part in _parts(lines, "event_id"):
        part.select("arrived", "value").write.format("datagram_log").mode("append").save(path)
        reader = spark.readStream.format("datagram_log").option("state", f"{state}/planned.json")
        rows = reader.option("bytes_per_trigger", 16 << 20).option("bytes_per_split", 1 << 20).load(path)
        # availableNow would end after one limited batch
        with setting(spark, "spark.sql.streaming.checkpointFileManagerClass", LOG_FILES):
            running = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    text = F.decode("value", "UTF-8")
    space = F.instr(text, " ")
    return spark.read.parquet(out).select(F.substring(text, F.lit(1), space - 1).cast("bigint").alias("arrival"), "arrived", F.substring(text, space + 1, F.length(text)).alias("value"))
