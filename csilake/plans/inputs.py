"""Telemetry inputs derived from the given tables: landed lines, control logs, dimensions.

The derivation is deterministic, so the same inputs can be stated in SQL over the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from csilake.functions.payload import payload_text
from csilake.functions.text import mac_text
from csilake.operators.wire import accepted, classify_lines, render_line
from csilake.schema import CLOCK_MODULUS
from csilake.session import new_folder

N_VALUES = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _payload_value(embedding: Column, i: Column) -> Column:
    even = (i / 2).cast("int")
    odd = (F.floor(i / 2).cast("int") + 32) % 64
    k = F.when(i % 2 == 0, even).otherwise(odd)
    return F.floor(F.get(embedding, k).cast("double") * 127).cast("int")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, payload) with 128 signed values per vector."""
    index = F.sequence(F.lit(0), F.lit(N_VALUES - 1))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform(index, lambda i: _payload_value(F.col("embedding"), i)).alias("payload")
    )


def device_mac(user_id: Column) -> Column:
    fixed = [F.lit(2), F.lit(0), F.lit(0), F.lit(0)]
    return mac_text(F.array(*[c.cast("bigint") for c in fixed], F.floor(user_id / 256), user_id % 256))


def sender_frames(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """One row per event with the columns of a received frame, payload still as text."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events = events if spread is None else events.repartition(spread)
    texts = payloads(spark, sf_dir).select("vec_id", payload_text(F.col("payload")).alias("data_text"))
    n = table(spark, sf_dir, "embeddings").select(F.count("*")).scalar()
    return (
        events.withColumn("vec_id", F.col("event_id") % n)
        .join(texts, "vec_id")
        .select(
            "event_id",
            F.col("user_id").alias("device"),
            "ts",
            F.to_date("ts").alias("session_date"),
            F.col("event_type").alias("scenario"),
            *[c.alias(name) for name, c in _wire_columns().items()],
            "data_text",
        )
    )


def _wire_columns() -> dict[str, Column]:
    event_id = F.col("event_id")
    # The constant radio fields of the derived frames.
    constants = {
        "rate": 11, "sig_mode": 1, "mcs": 7, "bandwidth": 1, "smoothing": 0, "not_sounding": 1,
        "aggregation": 0, "stbc": 1, "fec_coding": 0, "sgi": 0, "noise_floor": -93, "ampdu_cnt": 0,
        "secondary_channel": 0, "ant": 0, "sig_len": 67, "rx_state": 0, "len": N_VALUES, "first_word": 1,
    }
    columns = {name: F.lit(v) for name, v in constants.items()}
    columns["type"] = F.when(event_id % 83 == 2, "CSI_IP").otherwise("CSI_DATA")
    columns["seq"] = event_id
    columns["mac"] = device_mac(F.col("user_id"))
    rssi = -30 - F.floor("value") % 60
    columns["rssi"] = F.when(event_id % 89 == 1, "bad").otherwise(rssi.cast("string"))
    columns["channel"] = 1 + event_id % 13
    columns["local_timestamp"] = F.unix_micros(F.col("ts").cast("timestamp")) % CLOCK_MODULUS
    return columns


def csi_lines(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """Lines as sent: event_id is the arrival order, (device, session_date) the session."""
    frames = sender_frames(spark, sf_dir, spread)
    fields = {name: F.col(name) for name in _wire_columns()}
    line = F.when(F.col("event_id") % 97 == 0, render_line(fields, None)).otherwise(
        render_line(fields, F.col("data_text"))
    )
    return frames.select("event_id", "device", "ts", "session_date", "scenario", line.alias("value"))


_LANDED: dict[tuple[str, str], tuple[str, StructType]] = {}


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as receivers leave them: landed once for an application, in as many files as it has tasks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        lines = csi_lines(spark, sf_dir)
        path = new_folder(spark, "lines")
        # the given events are one row group, which one task would render
        csi_lines(spark, sf_dir, spread=spark.sparkContext.defaultParallelism).write.parquet(path)
        _LANDED[key] = (path, lines.schema)
    path, schema = _LANDED[key]
    return spark.read.schema(schema).parquet(path)


def stored_rows(spark: SparkSession, sf_dir: str, profile: str = "strict") -> DataFrame:
    """Accepted packets of the landed lines."""
    return accepted(classify_lines(landed_lines(spark, sf_dir), profile))


def byte_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as received: some with a byte that is no UTF-8, some with a real U+FFFD, all with blanks around."""
    event_id = F.col("event_id")
    head = F.concat(F.lit("CSI_DATA,"), event_id.cast("string"), F.lit(",é"))
    broken = F.when(event_id % 71 == 3, F.unhex(F.lit("FF"))).when(event_id % 73 == 5, F.unhex(F.lit("E282")))
    inserted = F.coalesce(broken, F.when(event_id % 79 == 7, F.encode(F.lit("�"), "UTF-8")), F.unhex(F.lit("")))
    tail = F.concat(F.lit(","), F.col("event_type"), F.lit(" \r\n"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.encode(F.concat(F.lit(" \t"), head), "UTF-8"), inserted, F.encode(tail, "UTF-8")).alias("value"),
    )


def start_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, device, ts, msg): a start command per signup; some carry no usable duration."""
    event_id = F.col("event_id")
    argument = (
        F.when(event_id % 10 == 0, "abc")
        .when(event_id % 10 == 1, "0")
        .otherwise((3600 + event_id % 7200).cast("string"))
    )
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'signup'")
        .select(
            event_id.alias("session_id"), F.col("user_id").alias("device"), "ts",
            F.concat(F.lit("start,"), argument).alias("msg"),
        )
    )


def repeat_messages(log: DataFrame, copies: int, seconds: int) -> DataFrame:
    """Each message several times, some seconds apart, as senders repeat it."""
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_copy") * seconds)
    return (
        log.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("ts", F.col("ts") + shift)
        .drop("_copy")
    )


def discovery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ts, msg): ten announcements per view event; every seventh event says something else."""
    event_id, user_id = F.col("event_id"), F.col("user_id")
    address = F.concat_ws(
        ".", F.lit("10"), F.floor(user_id / 256).cast("string"), (user_id % 256).cast("string"), (event_id % 250).cast("string")
    )
    tag = F.when(event_id % 7 == 0, "HELLO,").otherwise("CSI_IP,")
    boots = (
        table(spark, sf_dir, "events")
        .where("event_type = 'view'")
        .select(user_id.alias("device"), "ts", F.concat(tag, address).alias("msg"))
    )
    return repeat_messages(boots, 10, 2)


def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, arrival, failed): errors are disconnects, signups are connects."""
    return (
        table(spark, sf_dir, "events")
        .where("event_type in ('error', 'signup')")
        .select(
            F.col("user_id").alias("device"), F.col("event_id").alias("arrival"), (F.col("event_type") == "error").alias("failed")
        )
    )


def packet_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, device, ts, session_date) of every landed packet."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival"), F.col("user_id").alias("device"), "ts", F.to_date("ts").alias("session_date")
    )


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (device, session_date): stamp of the save, scenario as typed in, which may be empty."""
    events = table(spark, sf_dir, "events")
    return (
        events.groupBy(F.col("user_id").alias("device"), F.to_date("ts").alias("session_date"))
        .agg(F.max("ts").alias("captured_at"))
        .select(
            "device", "session_date", "captured_at",
            F.concat_ws("-", F.col("device").cast("string"), F.date_format("session_date", "yyyyMMdd")).alias("session_id"),
            F.expr("CASE WHEN device % 7 = 0 THEN '' ELSE concat('walk-', device % 5) END").alias("scenario"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("id"),
        F.col("c_name").alias("nome"),
        F.lower("c_mktsegment").alias("apelido"),
        F.when(F.col("c_acctbal") < 0, 0).otherwise(1).alias("status"),
    )


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, op, nome, apelido, status, at, nr): one change per order, ordered by at and nr."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    key = F.col("o_orderkey")
    op = F.when(key % 50 == 0, "I").when((F.col("o_orderstatus") == "F") & (key % 3 == 0), "D").otherwise("U")
    named = users(spark, sf_dir).select("id", "nome", "apelido")
    changes = orders.select(
        F.when(key % 50 == 0, 1_000_000 + key).otherwise(F.col("o_custkey") + 1).alias("id"),
        op.alias("op"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(2).alias("status"),
        F.col("o_orderdate").alias("at"),
        key.alias("nr"),
    )
    # Updates repeat the stored names; inserts bring their own.
    return changes.join(named, "id", "left").select(
        "id", "op",
        F.when(F.col("op") == "I", "new").otherwise(F.col("nome")).alias("nome"),
        F.when(F.col("op") == "I", "new").otherwise(F.col("apelido")).alias("apelido"),
        "status", "at", "nr",
    )


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (1 + F.col("p_size") % 4).cast("int").alias("width"),
        (1 + F.col("p_partkey") % 3).cast("int").alias("length"),
    )
