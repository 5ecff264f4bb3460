"""Sessions: from start commands, over packets, into numbered and tagged rows."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csilake.functions.numbers import digits_only, leading_int
from csilake.functions.text import scenario_or_default
from csilake.operators.asof import last_before
from csilake.operators.ordered import ROWS_PER_BLOCK, SECONDS_PER_BLOCK, arrival_block, row_numbers, running_total, time_block
from csilake.operators.repeats import collapse_repeats
from csilake.schema import START_TAG
from csilake.session import OPEN_FILES, OPEN_WRITERS, new_folder, setting

#: Ticks of a session's timer that are listed at once.
TICKS_PER_ROW = 1_000
#: Rows of a chunk of blocks, about; buckets per chunk, so that few chunks meet in one, and the most of them that Spark takes.
ROWS_PER_CHUNK, BUCKETS_PER_CHUNK, MOST_BUCKETS = 1 << 17, 2, 100_000


class Chunks(NamedTuple):
    """Rows lie stored by this column, in so many buckets."""

    column: str
    buckets: int


def read_starts(commands: DataFrame) -> DataFrame:
    """Start commands with their duration ``n`` in seconds; other messages are dropped.

    ``clean`` tells whether the duration would have passed the digits-only input field.
    """
    argument = F.substring(F.col("msg"), F.lit(len(START_TAG) + 1), F.length("msg"))
    return commands.where(F.col("msg").startswith(START_TAG)).select(
        "*", leading_int(argument).alias("n"), digits_only(argument).alias("clean")
    )


def sessions_from_starts(commands: DataFrame, gap_seconds: int = 10, block_seconds: int = SECONDS_PER_BLOCK) -> DataFrame:
    """(device, started_at, n, clean, repeats): one session per burst of repeated commands, n > 0 only.

    Senders repeat the command until the first packet arrives. The first of a burst starts the session.
    """
    starts = read_starts(commands).where(F.col("n") > 0).select("device", "ts", "n", "clean")
    bursts = collapse_repeats(starts, ["device", "n", "clean"], "ts", gap_seconds, block_seconds)
    return bursts.select(
        "device", F.col("first_ts").alias("started_at"), "n", "clean", F.col("copies").alias("repeats")
    )


def session_end(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def sessions_without_packets(packets: DataFrame, sessions: DataFrame, block_seconds: int = SECONDS_PER_BLOCK) -> DataFrame:
    """The sessions that have nothing to save: no packet of their device lies in them."""
    return sessions.join(packets_per_session(packets, sessions, block_seconds), "session_id", "left_anti")


def packets_per_session(
    packets: DataFrame, sessions: DataFrame, block_seconds: int = SECONDS_PER_BLOCK, weight: Column | None = None
) -> DataFrame:
    """Packets of the same device with ``started_at <= ts < started_at + n``, counted per session.

    ``weight`` is how many packets a row stands for, one by default.

    No packet meets a session: both go into one time order per device, packets by their number and
    session bounds as 0, and the running total at the end bound minus that at the start bound is the count.
    Overlapping and very long sessions cost two rows each, like any other.
    """
    bounds = sessions.select(
        "device",
        "session_id",
        "n",
        F.explode(
            F.array(
                F.struct(F.col("started_at").alias("ts"), F.lit(-1).alias("sign")),
                F.struct(session_end(F.col("started_at"), F.col("n")).alias("ts"), F.lit(1).alias("sign")),
            )
        ).alias("bound"),
    ).select("device", "bound.ts", F.lit(0).alias("weight"), "session_id", "n", "bound.sign")
    # Packets of one instant are counted before the shuffle.
    many = F.count("*") if weight is None else F.sum(weight)
    points = packets.groupBy("device", "ts").agg(many.cast("int").alias("weight")).select(
        "device",
        "ts",
        "weight",
        F.lit(None).cast("bigint").alias("session_id"),
        F.lit(None).cast("int").alias("n"),
        F.lit(0).alias("sign"),
    )
    # At equal times a bound sorts before a packet, so its total counts packets strictly before it.
    counted = running_total(
        points.unionByName(bounds),
        ["device"],
        ["ts", "weight"],
        time_block("ts", block_seconds),
        F.col("weight"),
        "seen",
    )
    return (
        counted.where(F.col("weight") == 0)
        .groupBy("session_id", "n")
        .agg(F.sum(F.col("seen") * F.col("sign")).alias("packets"))
        .where(F.col("packets") > 0)
    )


def progress_ticks(
    packets: DataFrame, sessions: DataFrame, period_seconds: int = 5, block_seconds: int = SECONDS_PER_BLOCK
) -> DataFrame:
    """(session_id, tick, in_buffer): what a session's timer reports at its start and every period after.

    Ticks come whether packets do or not, up to the end of the session or of the data. As above, ticks
    and packets share one time order, and no packet meets a tick.
    """
    last = packets.select(F.max("ts")).scalar()
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(period_seconds))
    # The final tick of a timer is its end, which reports nothing.
    final = F.least(session_end(F.col("started_at"), F.col("n") - 1), last)
    run = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(period_seconds * TICKS_PER_ROW))
    # Ticks are listed in runs of a set length, so no row holds all of a long session's.
    ticks = (
        sessions.where(F.col("started_at") <= last)
        .withColumn("_run", F.explode(F.sequence(F.col("started_at"), final, run)))
        .withColumn("ts", F.explode(F.sequence(F.col("_run"), F.least(final, F.col("_run") + run - step), step)))
        .select("device", "ts", F.lit(0).alias("weight"), "session_id", "started_at")
    )
    points = packets.groupBy("device", "ts").agg(F.count("*").cast("int").alias("weight")).select(
        "device", "ts", "weight", F.lit(None).cast("bigint").alias("session_id"), F.lit(None).cast("timestamp_ntz").alias("started_at")
    )
    counted = running_total(
        points.unionByName(ticks), ["device"], ["ts", "weight"], time_block("ts", block_seconds), F.col("weight"), "seen"
    ).where(F.col("weight") == 0)
    at_start = counted.where(F.col("ts") == F.col("started_at")).select("session_id", F.col("seen").alias("_before"))
    return counted.join(at_start, "session_id").select(
        "session_id", F.col("ts").alias("tick"), (F.col("seen") - F.col("_before")).alias("in_buffer")
    )


def bound_packets(
    packets: DataFrame, sessions: DataFrame, bucket_seconds: int = 3600
) -> DataFrame:
    """Packets with the ``session_id`` of every session that holds them.

    Sessions are listed in each time bucket they touch, so the join is an equality on device and
    bucket and the time bounds filter its few candidates. Buckets past the last packet are not listed.
    A full bucket is split at run time by the adaptive skew join, by its measured size.
    """
    last = packets.select(F.max("ts")).scalar()

    def bucket(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).cast("bigint")

    spans = (
        sessions.withColumn("_ends_at", session_end(F.col("started_at"), F.col("n")))
        .where(F.col("started_at") <= last)
        .withColumn("_bucket", F.explode(F.sequence(bucket(F.col("started_at")), bucket(F.least("_ends_at", last)))))
        .select("device", "session_id", F.col("started_at").alias("_starts_at"), "_ends_at", "_bucket")
    )
    return (
        packets.withColumn("_bucket", bucket(F.col("ts")))
        .join(spans, ["device", "_bucket"])
        .where((F.col("ts") >= F.col("_starts_at")) & (F.col("ts") < F.col("_ends_at")))
        .select(*packets.columns, "session_id")
    )


def tag_sessions(rows: DataFrame, sessions: DataFrame, on: list[str], chunks: Chunks | None = None) -> DataFrame:
    """Adds the session's ``session_id``, ``captured_at`` and ``scenario`` to each row.

    A row whose session is not known is kept, with nulls. Rows that lie in ``chunks`` stay there: the tags of a chunk's sessions
    are shuffled to it (under ``CO_PARTITION``, as ``append_sessions`` sets it for gathered rows).
    """
    tags = session_tags(sessions, on)
    if chunks is None:
        return rows.join(tags, on, "left")
    held = rows.select(chunks.column, *on).distinct().join(tags, on)
    return rows.join(held.repartition(chunks.buckets, chunks.column), [chunks.column, *on], "left")


def session_tags(sessions: DataFrame, on: list[str]) -> DataFrame:
    """What a session adds to its rows; an empty scenario gets the default."""
    return sessions.select(*on, "session_id", "captured_at", scenario_or_default(F.col("scenario")).alias("scenario"))


def tag_last_start(packets: DataFrame, sessions: DataFrame, block_seconds: int = SECONDS_PER_BLOCK) -> DataFrame:
    """Adds ``session_id``, ``started_at``, ``n`` of the device's last start at or before the packet, and ``inside``: whether it still ran.

    Of starts of one instant the one of the greatest id is the last. A packet before any start is kept, with nulls.
    """
    starts = sessions.select("device", "session_id", "started_at", "n")
    tagged = last_before(packets, starts, ["device"], "ts", "started_at", ["session_id"], block_seconds)
    return tagged.withColumn("inside", F.coalesce(F.col("ts") < session_end(F.col("started_at"), F.col("n")), F.lit(False)))


def packets_once(packets: DataFrame, session: list[str], seq: str, arrival: str) -> DataFrame:
    """Each (session, seq) once, as it first arrived: what repeated landing and repeated datagrams leave.

    Copies are combined before the shuffle. Packets without a number can't be told apart and are all kept.
    """
    rest = F.struct(*(c for c in packets.columns if c not in (*session, seq)))
    firsts = packets.where(F.col(seq).isNotNull()).groupBy(*session, seq).agg(F.min_by(rest, arrival).alias("_first"))
    return firsts.select(*session, seq, "_first.*").select(*packets.columns).unionByName(packets.where(F.col(seq).isNull()))


def assign_seq(rows: DataFrame, session: list[str], arrival: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds ``seq``: counter from 0 in each session, in arrival order."""
    return row_numbers(rows, session, [arrival], arrival_block(arrival, rows_per_block), "seq")


def _written(rows: DataFrame, name: str, compression: str = "snappy", chunks: Chunks | None = None) -> DataFrame:
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, name)
    writer = rows.write.option("compression", compression)
    if chunks is None:
        writer.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)
    # Only a table of the catalog can have buckets. Its name goes at once; the files stay, as they lie below a path of their own.
    table = f"{name}_{uuid.uuid4().hex}"
    with setting(spark, OPEN_WRITERS, OPEN_FILES):
        writer.bucketBy(chunks.buckets, chunks.column).option("path", path).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored


def number_rows(rows: DataFrame, order: list[str], out: str, first: int = 1) -> DataFrame:
    """Adds ``out``: first, first + 1, ... along ``order``, without a gap.

    Rows are cut into ranges of that order, whatever keys they fall in, and stored; a row's number is its place in its
    range plus the rows of the ranges before, of which there is one small row each. Nulls come first; no row is
    dropped. Rows alike in all order columns are numbered in any order.
    """
    # Ranges are sampled from stored rows, so what made the rows runs once.
    first_copy = _written(rows, "unranged")
    ranged = first_copy.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    stored = _written(ranged, "ranges")
    stored = stored.withColumns({"_range": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND((1 << 33) - 1)})
    counts = stored.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")
    offsets = counts.select("_range", (before + F.lit(first)).alias("_offset"))
    # one row a range: without the hint, Spark guesses their size from that of the rows and shuffles these again
    return stored.join(F.broadcast(offsets), "_range").select((F.col("_offset") + F.col("_row")).alias(out), *rows.columns)


def _rows_before(counts: DataFrame, order: list[str]) -> Column:
    return F.sum("_rows").over(Window.orderBy(*order)) - F.col("_rows")


def _of_blocks(blocks: DataFrame, order: list[str], column: Column) -> tuple[DataFrame, list[Column]]:
    """A column of the blocks for their rows, and what joins it to them, nulls included. Blocks are parts of files, of which Spark's
    driver lists the files anyhow, so it goes to all tasks."""
    known = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in order]
    return F.broadcast(blocks.select(*(F.col(c).alias(f"_of_{c}") for c in order), column)), known


def chunk_blocks(rows: DataFrame, order: list[str], column: str = "chunk", rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[DataFrame, Chunks]:
    """Adds the number of the chunk that a row's block belongs to: blocks that follow each other along ``order``, small ones together.

    Rows are counted per block first, for which landed text is read once more, but not parsed, moved or stored.
    """
    counts = _written(rows.groupBy(*order).agg(F.count("*").alias("_rows")), "counts")
    chunk, known = _of_blocks(counts, order, F.floor(_rows_before(counts, order) / rows_per_chunk).alias(column))
    total = counts.select(F.sum("_rows")).head()[0] or 0
    buckets = min(BUCKETS_PER_CHUNK * (total // rows_per_chunk + 1), MOST_BUCKETS)
    # a row of a block that was cut otherwise the second time would still be kept
    chunked = rows.join(chunk, known, "left").select(*rows.columns, F.coalesce(F.col(column), F.lit(0).cast("bigint")).alias(column))
    return chunked, Chunks(column, buckets)


def number_blocks(rows: DataFrame, order: list[str], out: str, first: int = 1, chunks: Chunks | None = None) -> DataFrame:
    """Adds ``out`` as ``number_rows`` does, to rows that lie in blocks: those alike in ``order`` are read by one task, one after the other.

    Landed lines are such rows, with the file and the place of its part in ``order``. They are stored once, and only counts of blocks are
    shuffled: a row's number is its place in its block plus the rows of the blocks before. With ``chunks`` they are stored by chunk.
    """
    stored = _written(rows.withColumn("_place", F.monotonically_increasing_id()), "placed", "zstd", chunks)
    counts = stored.groupBy(*order).agg(F.count("*").alias("_rows"), F.min("_place").alias("_start"))
    offsets, known = _of_blocks(counts, order, (_rows_before(counts, order) + F.lit(first) - F.col("_start")).alias("_offset"))
    return stored.join(offsets, known).select((F.col("_offset") + F.col("_place")).alias(out), *rows.columns)


def assign_row_id(
    rows: DataFrame, date: str, session: str, arrival: str, first_id: int = 1, tags: DataFrame | None = None
) -> DataFrame:
    """Adds ``id``: 1, 2, ... over sessions in (date, session) order, in arrival order inside each.

    ``first_id`` continues the numbers of earlier appends. ``tags``, one row per (date, session), are added too.
    """
    numbered = number_rows(rows, [date, session, arrival], "id", first_id)
    if tags is None:
        return numbered
    added = [c for c in tags.columns if c not in (date, session)]
    return numbered.join(tags, [date, session], "left").select("id", *rows.columns, *added)


def progress(packets: DataFrame, session: list[str], period: str = "5 seconds") -> DataFrame:
    """Packets in the session's buffer at the end of each period that received any.

    Packets are counted per period before the running sum, whose input is one row per period.
    """
    ticks = packets.groupBy(*session, F.window("ts", period).alias("_w")).agg(F.count("*").alias("packets"))
    so_far = Window.partitionBy(*session).orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ticks.select(*session, F.col("_w.end").alias("tick"), "packets").withColumn(
        "in_buffer", F.sum("packets").over(so_far)
    )


def first_packets(packets: DataFrame, session: list[str], arrival: str) -> DataFrame:
    """The first packet of each session: one scan, and one row per session and task is shuffled."""
    rest = F.struct(*(c for c in packets.columns if c not in session))
    firsts = packets.groupBy(*session).agg(F.min_by(rest, arrival).alias("_first"))
    return firsts.select(*session, "_first.*").select(*packets.columns)
