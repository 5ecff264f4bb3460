"""Registered queries: each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.functions import numbers, text
from csilake.functions.payload import payload_array, payload_text
from csilake.operators import control, grid, sessions, signal, streaks, users, views, wire
from csilake.plans import inputs
from csilake.schema import WIRE_FIELDS, WIRE_NAMES
from csilake.session import new_folder, prepare
from csilake.sources import landed, numbered, tables
from csilake.sources.collector_sqlite import CollectorSqlite, newest_first

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SESSION = ["device", "session_date"]
# The derived events are minutes apart, so periods and blocks are hours here, not seconds.
PROGRESS_PERIOD = "1 hour"
STREAK_THRESHOLD = 5
USER_BUCKETS = 8
BROKEN_ROW = "a row that can't be stored"


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


# --- records: render, ingest, filter, parse -------------------------------------------------------


@query
def render_lines(spark, sf_dir):
    return inputs.csi_lines(spark, sf_dir).select("event_id", "value")


@query
def ingest_lines(spark, sf_dir):
    path = new_folder(spark, "landed")
    landed.land_lines(inputs.csi_lines(spark, sf_dir), path, ["scenario"])
    return landed.ingest_lines(landed.read_lines(spark, path)).select("scenario", "value")


@query
def filter_prefix(spark, sf_dir):
    lines = inputs.landed_lines(spark, sf_dir)
    return lines.where(wire.has_prefix(F.col("value"))).select("event_id", "value")


@query
def parse_strict(spark, sf_dir):
    return inputs.stored_rows(spark, sf_dir).select("event_id", *WIRE_NAMES)


@query
def parse_lenient(spark, sf_dir):
    rows = inputs.stored_rows(spark, sf_dir, "lenient")
    return rows.select("event_id", *WIRE_NAMES, F.concat_ws(",", "bad_fields").alias("bad_fields"))


@query
def reject_reasons(spark, sf_dir):
    return wire.reject_reasons(wire.classify_lines(inputs.landed_lines(spark, sf_dir)))


@query
def reject_rows(spark, sf_dir):
    _, rejects = wire.parse_lines(inputs.landed_lines(spark, sf_dir))
    return rejects.select("event_id", "raw", "reason")


@query
def accept_reject_counts(spark, sf_dir):
    return wire.accept_counts(wire.classify_lines(inputs.landed_lines(spark, sf_dir)), "scenario")


@query
def decode_bytes(spark, sf_dir):
    value = F.col("value")
    return inputs.byte_lines(spark, sf_dir).select(
        "event_id",
        text.decode_line(value, "desktop").alias("desktop"),
        text.decode_line(value, "mobile").alias("mobile"),
    )


@query
def number_profiles(spark, sf_dir):
    """Number texts good and bad under both policies."""
    k = (F.col("event_id") % 1000).cast("string")
    forms = [
        k, F.concat(F.lit("+"), k), F.concat(F.lit(" "), k, F.lit(" ")), F.concat(k, F.lit(".0")), F.lit(""), F.lit("abc"),
        F.concat(F.lit("2147483"), F.lpad(k, 3, "0")), F.concat(k, F.lit("f")), F.concat(F.lit('"'), k, F.lit('"')),
        F.concat(k, F.lit("e2")), F.concat(F.lit("0x"), k), F.concat(k, F.lit(".5")),
    ]
    forms_table = inputs.table(spark, sf_dir, "events").select(
        "event_id", F.get(F.array(*forms), (F.col("event_id") % len(forms)).cast("int")).alias("field")
    )
    field, clean = F.col("field"), text.clean_field(F.col("field"))
    return forms_table.select(
        "event_id",
        numbers.strict_int(clean).alias("strict_int"),
        numbers.strict_int(clean, "bigint").alias("strict_long"),
        numbers.strict_float(clean).cast("double").alias("strict_float"),
        numbers.lenient_int(field).alias("lenient_int"),
        numbers.lenient_int(field, "bigint").alias("lenient_long"),
        numbers.lenient_float(field).cast("double").alias("lenient_float"),
    )


@query
def filter_sender(spark, sf_dir):
    """Frames of one sender."""
    frames = inputs.stored_rows(spark, sf_dir)
    return frames.where(F.col("mac") == "02:00:00:00:00:07").select("event_id", "mac", "rssi")


@query
def filter_sender_list(spark, sf_dir):
    """Frames of the senders on a list, and how many others there were."""
    frames = inputs.stored_rows(spark, sf_dir)
    allowed = inputs.table(spark, sf_dir, "events").where("event_type = 'error' and event_id % 11 = 0").select(
        inputs.device_mac(F.col("user_id")).alias("mac")
    ).distinct()
    counts = frames.groupBy("mac").agg(F.count("*").alias("n"))
    listed = counts.join(allowed.withColumn("allowed", F.lit(True)), "mac", "left")
    return listed.select("mac", "n", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def _by_sender(spark, sf_dir):
    """Packets stored by sender bucket, and a list of senders."""
    path = new_folder(spark, "by-sender")
    tables.append_by_sender(inputs.stored_rows(spark, sf_dir).select("event_id", "mac", "rssi"), path)
    listed = inputs.table(spark, sf_dir, "events").where("event_type = 'error' and event_id % 101 = 7")
    return tables.read_table(spark, path, f"event_id bigint, mac string, rssi int, {tables.SENDER_BUCKET} int"), listed.select(inputs.device_mac(F.col("user_id")).alias("mac"))


@query
def allowed_senders(spark, sf_dir):
    return control.allowed_senders(*_by_sender(spark, sf_dir)).select("event_id", "mac", "rssi")


@query
def other_senders(spark, sf_dir):
    return control.allowed_senders(*_by_sender(spark, sf_dir), keep=False).select("event_id", "mac", "rssi")


@query
def parse_lenient_variant(spark, sf_dir):
    """Fields stored as number or text, as they came, and read back."""
    path = new_folder(spark, "variants")
    wire.with_stored_text(inputs.stored_rows(spark, sf_dir, "lenient")).select("event_id", "rssi", "channel", "rate").write.parquet(path)
    number = F.try_variant_get("rssi", "$", "int")
    texts = [F.variant_get(c, "$", "string").alias(c) for c in ("rssi", "channel")]
    return spark.read.parquet(path).select("event_id", *texts, F.variant_get("rate", "$", "double").alias("rate"), number.alias("rssi_number"))


def _listed(summary):
    return summary.withColumn("channels", F.array_join("channels", ","))


@query
def scenario_summary(spark, sf_dir):
    return _listed(views.scenario_summary(inputs.stored_rows(spark, sf_dir)))


@query
def scenario_summary_by_day(spark, sf_dir):
    """The same from stored sums of each day."""
    path = new_folder(spark, "summary-parts")
    views.summary_parts(inputs.stored_rows(spark, sf_dir), "session_date").write.parquet(path)
    return _listed(views.summary_of_parts(spark.read.parquet(path)))


# --- sessions and stored tables -------------------------------------------------------------------


@query
def tag_sessions(spark, sf_dir):
    packets = inputs.packet_times(spark, sf_dir)
    tagged = sessions.tag_sessions(packets, inputs.session_table(spark, sf_dir), SESSION)
    return tagged.select("arrival", "session_id", "captured_at", "scenario")


def _wire_rows(spark, sf_dir):
    """Accepted packets without what only the parser needs."""
    return inputs.stored_rows(spark, sf_dir).select("event_id", *SESSION, *WIRE_NAMES)


@query
def append_sessions(spark, sf_dir):
    """Two appends to one table: the sessions of even devices, then those of odd ones."""
    path = new_folder(spark, "packets")
    rows = inputs.stored_rows(spark, sf_dir).drop("payload", "bad_fields", "raw")
    tables.append_sessions(rows.where("device % 2 = 0"), path)
    tables.append_sessions(rows.where("device % 2 = 1"), path)
    return tables.read_table(spark, path).select("event_id", "device", F.col("session_date").cast("date"), "scenario", "rssi", "data")


@query
def append_all_or_nothing(spark, sf_dir):
    """An append, and a second one that fails at one of its rows: the table is as the first left it."""
    path = new_folder(spark, "packets")
    rows = inputs.stored_rows(spark, sf_dir).drop("payload", "bad_fields", "raw")
    tables.append_sessions(rows.where("device % 2 = 0"), path)
    rest = rows.where("device % 2 = 1")
    last = rest.agg(F.max("event_id")).head()[0]
    broken = F.when(F.col("event_id") == last, F.raise_error(F.lit(BROKEN_ROW)).cast("int")).otherwise(F.col("rssi"))
    try:
        tables.append_sessions(rest.withColumn("rssi", broken), path)
    except Exception as failure:  # of the task's own error, whatever it is wrapped in
        if BROKEN_ROW not in str(failure):
            raise
    return tables.read_table(spark, path).select("event_id", "device", F.col("session_date").cast("date"), "scenario", "rssi")


@query
def overwrite_session(spark, sf_dir):
    """Every session saved, then those of one scenario saved again with other values."""
    path = new_folder(spark, "sessions")
    rows = inputs.stored_rows(spark, sf_dir).select("event_id", "session_date", "scenario", "seq", "rssi")
    keys = ["session_date", "scenario"]
    tables.overwrite_session(rows, path, keys)
    tables.overwrite_session(rows.where("scenario = 'click'").withColumn("rssi", F.col("rssi") - 100), path, keys)
    return tables.read_table(spark, path).select("event_id", F.col("session_date").cast("date"), "scenario", "seq", "rssi")


@query
def ingest_pipeline(spark, sf_dir):
    """Landed files to numbered, parsed, tagged and stored packets and stored rejects; rows per session and reason."""
    path, table, bad = (new_folder(spark, x) for x in ("landed", "packets", "rejects"))
    landed.land_lines(inputs.csi_lines(spark, sf_dir), path, ["session_date"], "gzip", "device")
    lines = landed.clean_lines(landed.read_lines(spark, path, "device"), "mobile")
    blocks = ["session_date", "file", "file_block"]
    lines, chunks = sessions.chunk_blocks(lines, blocks)
    # classified before they are stored, so lines are parsed once and only rejects are stored as text
    classified = wire.classify_lines(lines, "strict").drop("payload", "bad_fields")
    classified = classified.withColumn("raw", F.when(F.col("reject_reason").isNotNull(), F.col("raw")))
    numbered = sessions.number_blocks(classified, blocks, "arrival", chunks=chunks)
    # by device as landed, not by the text of its mac, which devices share from the 65,536th on
    device = F.coalesce(F.col("device").cast("string"), F.lit(""))
    tags = inputs.session_table(spark, sf_dir).withColumn("device", device)
    tagged = sessions.tag_sessions(wire.accepted(numbered), tags, SESSION, chunks)
    tables.append_sessions(tagged.drop("raw", "device", chunks.column), table, gathered=True)
    wire.rejected(numbered, ["arrival"]).write.parquet(bad)
    counts = [F.count("*").alias("n"), F.count_distinct("arrival").alias("arrivals")]
    kept = spark.read.parquet(table).groupBy(F.col("session_id").alias("kind"), "captured_at", "scenario").agg(*counts)
    reasons = spark.read.parquet(bad).groupBy(F.col("reason").alias("kind")).agg(*counts)
    return kept.unionByName(reasons, allowMissingColumns=True)


@query
def delete_all(spark, sf_dir):
    """A table filled, emptied, and filled again with other sessions."""
    path = new_folder(spark, "packets")
    rows = inputs.stored_rows(spark, sf_dir).select("event_id", "device", "session_date", "rssi")
    tables.append_sessions(rows, path)
    tables.delete_all(spark, path)
    tables.append_sessions(rows.where("device % 2 = 1"), path)
    return tables.read_table(spark, path).select("event_id", F.col("session_date").cast("date"), "rssi")


@query
def schema_growth(spark, sf_dir):
    """Files from before a column was added, read together with later ones."""
    path = new_folder(spark, "packets")
    rows = inputs.stored_rows(spark, sf_dir).select("event_id", "device", "session_date", "rssi")
    tables.append_sessions(rows.where("device % 2 = 0").drop("rssi"), path)
    tables.append_sessions(rows.where("device % 2 = 1"), path)
    return tables.read_table(spark, path).select("event_id", F.col("session_date").cast("date"), "rssi")


@query
def union_profiles(spark, sf_dir):
    """Desktop rows and mobile rows, each under its own column names, as one table."""
    rows = sessions.tag_sessions(
        _wire_rows(spark, sf_dir), inputs.session_table(spark, sf_dir), SESSION
    ).select("event_id", "captured_at", "scenario", *WIRE_NAMES)
    desktop = views.to_stored_names(rows.where("event_id % 2 = 0").drop("event_id"), "desktop")
    mobile = views.to_stored_names(rows.where("event_id % 2 = 1").drop("event_id"), "mobile")
    return views.union_layouts(desktop, mobile)


@query
def assign_seq(spark, sf_dir):
    return sessions.assign_seq(inputs.packet_times(spark, sf_dir), SESSION, "arrival").select(
        "arrival", "device", "session_date", "seq"
    )


def _with_ids(spark, sf_dir):
    """Stored rows under the ids that appending them session by session gives."""
    tags = sessions.session_tags(inputs.session_table(spark, sf_dir), SESSION)
    return sessions.assign_row_id(_wire_rows(spark, sf_dir), "session_date", "device", "event_id", tags=tags)


@query
def assign_row_id(spark, sf_dir):
    rows = inputs.stored_rows(spark, sf_dir).select("event_id", "device", "session_date")
    return sessions.assign_row_id(rows, "session_date", "device", "event_id")


@query
def first_packet(spark, sf_dir):
    lines = inputs.landed_lines(spark, sf_dir)
    packets = lines.where(wire.has_prefix(F.col("value")))
    return sessions.first_packets(packets, SESSION, "event_id").select(*SESSION, "event_id", "value")


@query
def sessions_parse(spark, sf_dir):
    commands = inputs.repeat_messages(inputs.start_commands(spark, sf_dir), 3, 3)
    return sessions.sessions_from_starts(commands)


def _sessions(spark, sf_dir):
    starts = sessions.read_starts(inputs.start_commands(spark, sf_dir)).where("n > 0")
    return starts.select("session_id", "device", F.col("ts").alias("started_at"), "n")


@query
def session_bound(spark, sf_dir):
    return sessions.packets_per_session(inputs.packet_times(spark, sf_dir), _sessions(spark, sf_dir))


@query
def sessions_without_packets(spark, sf_dir):
    """Sessions that are not saved, since they are empty."""
    empty = sessions.sessions_without_packets(inputs.packet_times(spark, sf_dir), _sessions(spark, sf_dir))
    return empty.select("session_id", "device", "started_at", "n")


@query
def session_packets(spark, sf_dir):
    packets = inputs.packet_times(spark, sf_dir).select("arrival", "device", "ts")
    return sessions.bound_packets(packets, _sessions(spark, sf_dir))


@query
def progress_5s(spark, sf_dir):
    return sessions.progress(inputs.packet_times(spark, sf_dir), SESSION, PROGRESS_PERIOD)


@query
def progress_ticks(spark, sf_dir):
    return sessions.progress_ticks(inputs.packet_times(spark, sf_dir), _sessions(spark, sf_dir), 1800)


@query
def tag_last_start(spark, sf_dir):
    packets = inputs.packet_times(spark, sf_dir).select("arrival", "device", "ts")
    return sessions.tag_last_start(packets, _sessions(spark, sf_dir))


@query
def packets_once(spark, sf_dir):
    """Packets of which some files landed twice, each once."""
    packets = inputs.packet_times(spark, sf_dir).withColumn("seq", F.col("arrival") % 100_000)
    again = packets.where("arrival % 5 < 2").withColumn("arrival", F.col("arrival") + 1_000_000_000)
    return sessions.packets_once(packets.unionByName(again), SESSION, "seq", "arrival").select("arrival", *SESSION, "seq", "ts")


# --- viewer ---------------------------------------------------------------------------------------


@query
def view_newest_first(spark, sf_dir):
    return views.newest_first(_with_ids(spark, sf_dir)).select("id", "captured_at", "scenario", *WIRE_NAMES)


@query
def view_newest_100(spark, sf_dir):
    return views.card(views.newest_first(_with_ids(spark, sf_dir), 100))


def _numbered(spark, sf_dir):
    """A table of two appends, the sessions of even devices and then those of odd ones, under ids that go on."""
    path = new_folder(spark, "numbered")
    rows = _wire_rows(spark, sf_dir)
    order = ["session_date", "device", "event_id"]
    numbered.append_numbered(rows.where("device % 2 = 0"), path, order)
    numbered.append_numbered(rows.where("device % 2 = 1"), path, order)
    return path


@query
def append_numbered(spark, sf_dir):
    return spark.read.parquet(_numbered(spark, sf_dir)).select("id", "event_id", "device", "session_date")


@query
def view_page(spark, sf_dir):
    """The second page of 50 rows from the newest on, by stored ids."""
    path = _numbered(spark, sf_dir)
    newest = numbered.page(spark, path, 50)
    return numbered.page(spark, path, 50, before=newest.agg(F.min("id")).head()[0]).select("id", "event_id", "mac", "rssi")


@query
def view_card(spark, sf_dir):
    return views.card(_with_ids(spark, sf_dir))


@query
def view_count(spark, sf_dir):
    return views.count(inputs.stored_rows(spark, sf_dir))


@query
def csv_roundtrip(spark, sf_dir):
    path = new_folder(spark, "csv")
    tables.export_csv(inputs.stored_rows(spark, sf_dir).select("event_id", *WIRE_NAMES), path)
    schema = "event_id bigint, " + ", ".join(f"`{name}` {kind}" for name, kind in WIRE_FIELDS)
    return tables.read_csv(spark, path, schema)


def _collected(spark, sf_dir):
    """Rows saved as collector files in both layouts."""
    path, table = new_folder(spark, "collected"), new_folder(spark, "stored")
    spark.dataSource.register(CollectorSqlite)
    _with_ids(spark, sf_dir).select("id", "captured_at", "scenario", *WIRE_NAMES).write.parquet(table)
    rows = spark.read.parquet(table)
    for layout, part in (("desktop", "id % 2 = 0"), ("mobile", "id % 2 = 1")):
        rows.where(part).write.format("collector_sqlite").option("layout", layout).mode("append").save(path)
    return path


@query
def collector_roundtrip(spark, sf_dir):
    """Rows saved as collector files and read back under the canonical names."""
    return spark.read.format("collector_sqlite").load(_collected(spark, sf_dir)).select("id", "captured_at", "scenario", *WIRE_NAMES)


@query
def collector_newest_first(spark, sf_dir):
    """The newest 100 rows over all collector files, stamps as stored."""
    rows = newest_first(spark, _collected(spark, sf_dir), 100)
    return rows.select("id", "captured_at", "scenario", "mac", "rssi")


# --- control logs ---------------------------------------------------------------------------------


@query
def discovery_first(spark, sf_dir):
    return control.discovery_first(inputs.discovery_log(spark, sf_dir))


@query
def discovery_listen(spark, sf_dir):
    """Windows from the start of listening; the derived events are hours apart, so they last that long here."""
    clicks = inputs.table(spark, sf_dir, "events").where("event_type = 'click'")
    listening = clicks.select(F.col("event_id").alias("listen_id"), F.col("user_id").alias("device"), F.col("ts").alias("listen_from"))
    return control.discovery_listen(inputs.discovery_log(spark, sf_dir), listening, 4 * 3600)


@query
def discovery_latest(spark, sf_dir):
    return control.discovery_latest(inputs.discovery_log(spark, sf_dir))


@query
def discovery_dedup(spark, sf_dir):
    return control.discovery_dedup(inputs.discovery_log(spark, sf_dir))


def messages(spark, sf_dir):
    """Every landed message of every kind."""
    logs = [inputs.discovery_log(spark, sf_dir), inputs.start_commands(spark, sf_dir)]
    mixed = inputs.csi_lines(spark, sf_dir).select("value")
    for log in logs:
        mixed = mixed.unionByName(log.select(F.col("msg").alias("value")))
    return mixed


@query
def route_counts(spark, sf_dir):
    return control.route_counts(messages(spark, sf_dir))


@query
def failure_streaks(spark, sf_dir):
    found = streaks.failure_streaks(inputs.link_events(spark, sf_dir), STREAK_THRESHOLD)
    return found.withColumnRenamed("device", "user_id")


# --- dimensions -----------------------------------------------------------------------------------


@query
def users_all(spark, sf_dir):
    return inputs.users(spark, sf_dir)


@query
def users_count(spark, sf_dir):
    return users.count(inputs.users(spark, sf_dir))


@query
def users_valid(spark, sf_dir):
    """Some users get blanks around or instead of a name."""
    blank = F.when(F.col("id") % 10 == 0, F.lit(" \t")).when(F.col("id") % 10 == 1, F.concat(F.lit("  "), "nome", F.lit(" ")))
    typed = inputs.users(spark, sf_dir).withColumn("nome", F.coalesce(blank, "nome"))
    valid, rejects = users.validate(typed)
    return valid.select("id", "nome", "apelido", F.lit("").alias("missing")).unionByName(
        rejects.select("id", "nome", "apelido", "missing")
    )


@query
def user_status_label(spark, sf_dir):
    return users.label(inputs.users(spark, sf_dir))


@query
def users_apply_changes(spark, sf_dir):
    return users.apply_changes(inputs.users(spark, sf_dir), inputs.user_changes(spark, sf_dir), ["at", "nr"])


@query
def users_merge_bucketed(spark, sf_dir):
    """The same snapshot from a base and a change log that lie bucketed by id: neither is exchanged."""
    stored = [
        tables.save_bucketed(rows, f"{name}_{uuid.uuid4().hex}", new_folder(spark, name), "id", USER_BUCKETS)
        for name, rows in (("users", inputs.users(spark, sf_dir)), ("changes", inputs.user_changes(spark, sf_dir)))
    ]
    return users.apply_changes(*stored, ["at", "nr"])


@query
def users_change_report(spark, sf_dir):
    return users.change_report(inputs.users(spark, sf_dir), inputs.user_changes(spark, sf_dir), ["at", "nr"])


@query
def entity_text(spark, sf_dir):
    rows = inputs.users(spark, sf_dir)
    return rows.select("id", text.user_text(F.col("id"), F.col("nome"), F.col("apelido"), F.col("status")).alias("entity"))


@query
def survey_text(spark, sf_dir):
    """Rooms and their points as text."""
    rooms = inputs.rooms(spark, sf_dir)
    sized = rooms.select("id", (F.col("width") / 2).alias("w"), F.col("length").cast("double").alias("l"))
    room = text.room_text(F.col("id"), F.concat(F.lit("Sala "), "id"), F.col("w"), F.col("l"), F.lit(1))
    points = grid.grid_points(rooms)
    x, y = (F.col("x") / 4).alias("x"), F.col("y").cast("double")
    point = text.point_text(F.col("numero"), F.col("room_id"), F.col("numero"), x, y, F.lit(0))
    return sized.select("id", room.alias("entity")).unionByName(points.select(F.col("room_id").alias("id"), point.alias("entity")))


@query
def grid_points(spark, sf_dir):
    return grid.grid_points(inputs.rooms(spark, sf_dir))


@query
def points_with_room(spark, sf_dir):
    """Points listed as two coordinate arrays per room, joined back to the room."""
    spark_rooms = inputs.rooms(spark, sf_dir)
    steps = F.sequence(F.lit(1), F.col("width"))
    listed = spark_rooms.select(
        "id",
        F.transform(steps, lambda i: i.cast("double") / 2).alias("pontos_x"),
        F.transform(steps, lambda i: (i * F.col("length")).cast("double")).alias("pontos_y"),
    )
    return grid.points_with_room(grid.coordinates(listed), spark_rooms)


# --- scalar functions -----------------------------------------------------------------------------


@query
def scalar_texts(spark, sf_dir):
    """Addresses, stamps in both stored forms and back, and the integer rule of start commands."""
    events = inputs.table(spark, sf_dir, "events")
    k = F.col("event_id") % 100
    argument = F.get(
        F.array(
            k.cast("string"), F.concat(F.lit(" "), k.cast("string"), F.lit("s")), F.concat(F.lit("-"), k.cast("string")),
            F.lit("abc"), F.lit(""), F.concat(k.cast("string"), F.lit(".9")), F.lit("99999999999"),
        ),
        (F.col("event_id") % 7).cast("int"),
    )
    return events.select(
        "event_id",
        inputs.device_mac(F.col("user_id")).alias("mac"),
        text.iso_text(F.col("ts")).alias("desktop_stamp"),
        text.second_text(F.col("ts")).alias("mobile_stamp"),
        text.read_stamp(text.iso_text(F.col("ts"))).alias("desktop_read"),
        text.read_stamp(text.second_text(F.col("ts"))).alias("mobile_read"),
        numbers.leading_int(argument).alias("seconds"),
    )


@query
def payload_text_roundtrip(spark, sf_dir):
    texts = inputs.payloads(spark, sf_dir).select("vec_id", payload_text(F.col("payload")).alias("data"))
    values = payload_array(F.col("data"))
    return texts.select(
        "vec_id", "data", F.size(values).alias("n"),
        F.aggregate(values, F.lit(0).cast("bigint"), lambda total, v: total + v).alias("total"),
    )


# --- derived: payload and timing ------------------------------------------------------------------


@query
def payload_long(spark, sf_dir):
    long = signal.payload_long(inputs.stored_rows(spark, sf_dir), "scenario")
    return long.groupBy("scenario", "idx").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@query
def payload_integrity(spark, sf_dir):
    """Packets of some devices claim a length that their payload does not have."""
    rows = inputs.stored_rows(spark, sf_dir)
    claimed = rows.withColumn("len", F.when(F.col("device") % 9 == 0, F.col("len") - 64).otherwise(F.col("len")))
    return signal.payload_integrity(claimed).select("event_id", "len", F.size("payload").alias("found"))


@query
def magnitude_by_index(spark, sf_dir):
    long = signal.magnitude_long(inputs.stored_rows(spark, sf_dir), "scenario")
    milli = F.floor(F.col("magnitude") * 1000).cast("bigint")
    return long.groupBy("scenario", "pair").agg(F.count("*").alias("n"), F.sum(milli).alias("milli"), F.max(milli).alias("peak"))


@query
def seq_gaps(spark, sf_dir):
    return signal.seq_gaps(inputs.stored_rows(spark, sf_dir), SESSION, "event_id")


@query
def interarrival(spark, sf_dir):
    return signal.interarrival(inputs.stored_rows(spark, sf_dir), SESSION, "event_id")
