"""The registered queries once more as SQL over the given tables, written independently of the jobs.

Packets are computed straight from the tables: no line is rendered and parsed again here.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Frames, with reject reason and the texts a line is made of.
FRAMES = """
WITH payloads AS (
  SELECT vec_id, list_transform(range(0, 128), lambda i: CAST(floor(CAST(embedding[1 +
    (CASE WHEN i % 2 = 0 THEN i // 2 ELSE (i // 2 + 32) % 64 END)] AS DOUBLE) * 127) AS INT)) AS payload
  FROM embeddings
), frames AS (
  SELECT e.event_id, e.user_id AS device, e.ts, CAST(e.ts AS DATE) AS session_date, e.event_type AS scenario,
    CAST(-30 - CAST(floor(e.value) AS BIGINT) % 60 AS INT) AS rssi_value,
    '02:00:00:00:' || lower(lpad(to_hex(e.user_id // 256), 2, '0')) || ':' || lower(lpad(to_hex(e.user_id % 256), 2, '0')) AS mac,
    CAST(1 + e.event_id % 13 AS INT) AS channel,
    epoch_us(e.ts) % 4294967296 AS local_timestamp,
    p.payload,
    '[' || array_to_string(p.payload, ',') || ']' AS data,
    CASE WHEN e.event_id % 83 = 2 THEN 'prefix' WHEN e.event_id % 97 = 0 THEN 'field_count'
         WHEN e.event_id % 89 = 1 THEN 'bad_number' END AS reason
  FROM events e JOIN payloads p ON p.vec_id = e.event_id % (SELECT count(*) FROM embeddings)
), lines AS (
  SELECT *, (CASE WHEN event_id % 83 = 2 THEN 'CSI_IP' ELSE 'CSI_DATA' END) || ',' || event_id || ',' || mac || ',' ||
    (CASE WHEN event_id % 89 = 1 THEN 'bad' ELSE CAST(rssi_value AS VARCHAR) END) ||
    ',11,1,7,1,0,1,0,1,0,0,-93,0,' || channel || ',0,' || local_timestamp || ',0,67,0,128,1' ||
    (CASE WHEN event_id % 97 = 0 THEN '' ELSE ',"' || data || '"' END) AS value
  FROM frames
), stored AS (
  SELECT *, 'CSI_DATA' AS type, CAST(event_id AS INT) AS seq, rssi_value AS rssi, CAST(11 AS FLOAT) AS rate, 1 AS sig_mode, 7 AS mcs,
    1 AS bandwidth, 0 AS smoothing, 1 AS not_sounding, 0 AS aggregation, 1 AS stbc, 0 AS fec_coding, 0 AS sgi, -93 AS noise_floor,
    0 AS ampdu_cnt, 0 AS secondary_channel, 0 AS ant, 67 AS sig_len, 0 AS rx_state, 128 AS len, 1 AS first_word
  FROM frames WHERE reason IS NULL
), session_table AS (
  SELECT user_id AS device, CAST(ts AS DATE) AS session_date, max(ts) AS captured_at,
    user_id || '-' || strftime(CAST(ts AS DATE), '%Y%m%d') AS session_id,
    CASE WHEN user_id % 7 = 0 THEN 'N/A' ELSE 'walk-' || (user_id % 5) END AS scenario
  FROM events GROUP BY ALL
), tagged AS (
  SELECT s.* EXCLUDE (scenario), t.captured_at, t.session_id, t.scenario,
    row_number() OVER (ORDER BY s.session_date, s.device, s.event_id) AS id
  FROM stored s JOIN session_table t ON t.device = s.device AND t.session_date = s.session_date
), starts AS (
  SELECT event_id AS session_id, user_id AS device, ts AS started_at, CAST(3600 + event_id % 7200 AS INT) AS n
  FROM events WHERE event_type = 'signup' AND event_id % 10 NOT IN (0, 1)
), announcements AS (
  SELECT user_id AS device, ts + to_seconds(2 * c) AS ts, event_id % 7 <> 0 AS announces,
    concat_ws('.', '10', user_id // 256, user_id % 256, event_id % 250) AS address
  FROM events, unnest(range(0, 10)) AS copies(c) WHERE event_type = 'view'
), users AS (
  SELECT c_custkey + 1 AS id, c_name AS nome, lower(c_mktsegment) AS apelido, CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS status
  FROM customer
), changes AS (
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN 1000000 + o_orderkey ELSE o_custkey + 1 END AS id,
    CASE WHEN o_orderkey % 50 = 0 THEN 'I' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'D' ELSE 'U' END AS op,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS status, o_orderdate AS changed_at, o_orderkey AS nr
  FROM orders
), rooms AS (
  SELECT p_partkey AS id, CAST(1 + p_size % 4 AS INT) AS width, CAST(1 + p_partkey % 3 AS INT) AS length FROM part
)
"""

WIRE = (
    "type, seq, mac, rssi, rate, sig_mode, mcs, bandwidth, smoothing, not_sounding, aggregation, stbc, fec_coding, sgi, "
    "noise_floor, ampdu_cnt, channel, secondary_channel, local_timestamp, ant, sig_len, rx_state, len, first_word, data"
)


def oracle(name: str, body: str) -> None:
    ORACLE[name] = FRAMES + body


oracle("render_lines", "SELECT event_id, value FROM lines")
oracle("ingest_lines", "SELECT scenario, value FROM lines WHERE value LIKE 'CSI\\_DATA%' ESCAPE '\\'")
oracle("filter_prefix", "SELECT event_id, value FROM lines WHERE event_id % 83 <> 2")
oracle("parse_strict", f"SELECT event_id, {WIRE} FROM stored")
oracle(
    "parse_lenient",
    f"""SELECT event_id, {WIRE.replace('rssi,', 'CASE WHEN event_id % 89 = 1 THEN NULL ELSE rssi_value END AS rssi,')},
      CASE WHEN event_id % 89 = 1 THEN 'rssi' ELSE '' END AS bad_fields
    FROM (SELECT *, 'CSI_DATA' AS type, CAST(event_id AS INT) AS seq, CAST(11 AS FLOAT) AS rate, 1 AS sig_mode, 7 AS mcs,
        1 AS bandwidth, 0 AS smoothing, 1 AS not_sounding, 0 AS aggregation, 1 AS stbc, 0 AS fec_coding, 0 AS sgi,
        -93 AS noise_floor, 0 AS ampdu_cnt, 0 AS secondary_channel, 0 AS ant, 67 AS sig_len, 0 AS rx_state, 128 AS len,
        1 AS first_word FROM frames WHERE reason IS NULL OR reason = 'bad_number')""",
)
oracle("reject_reasons", "SELECT reason, count(*) AS n FROM frames WHERE reason IS NOT NULL GROUP BY reason")
oracle("reject_rows", "SELECT event_id, value AS raw, reason FROM lines WHERE reason IS NOT NULL")
oracle(
    "accept_reject_counts",
    "SELECT scenario, count(*) FILTER (reason IS NULL) AS accepted, count(*) AS total FROM frames GROUP BY scenario",
)
oracle(
    "decode_bytes",
    """, parts AS (
      SELECT event_id, 'CSI_DATA,' || event_id || ',é' AS head, ',' || event_type AS tail,
        event_id % 71 = 3 OR event_id % 73 = 5 AS broken, event_id % 79 = 7 AS sent FROM events)
    SELECT event_id, head || (CASE WHEN broken THEN '' WHEN sent THEN chr(65533) ELSE '' END) || tail AS desktop,
      head || (CASE WHEN broken OR sent THEN chr(65533) ELSE '' END) || tail AS mobile FROM parts""",
)
oracle(
    "number_profiles",
    """, forms AS (
      SELECT event_id, CAST(event_id % 1000 AS VARCHAR) AS k, event_id % 12 AS form FROM events
    ), texts AS (
      SELECT event_id, CASE form WHEN 0 THEN k WHEN 1 THEN '+' || k WHEN 2 THEN ' ' || k || ' ' WHEN 3 THEN k || '.0' WHEN 4 THEN ''
        WHEN 5 THEN 'abc' WHEN 6 THEN '2147483' || lpad(k, 3, '0') WHEN 7 THEN k || 'f' WHEN 8 THEN '"' || k || '"'
        WHEN 9 THEN k || 'e2' WHEN 10 THEN '0x' || k ELSE k || '.5' END AS field FROM forms
    ), cleaned AS (
      SELECT event_id, trim(field) AS bare, replace(trim(field), '"', '') AS clean FROM texts
    ), shaped AS (
      SELECT *, CASE WHEN regexp_full_match(clean, '[+-]?[0-9]+') THEN try_cast(clean AS BIGINT) END AS whole,
        CASE WHEN regexp_full_match(clean, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[fFdD]?')
          THEN try_cast(rtrim(clean, 'fFdD') AS FLOAT) END AS real,
        CASE WHEN regexp_full_match(bare, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
          THEN try_cast(bare AS DOUBLE) END AS loose
      FROM cleaned
    )
    SELECT event_id,
      CASE WHEN whole BETWEEN -2147483648 AND 2147483647 THEN CAST(whole AS INT) END AS strict_int,
      whole AS strict_long, CAST(real AS DOUBLE) AS strict_float,
      CASE WHEN loose = floor(loose) AND loose BETWEEN -2147483648 AND 2147483647 THEN CAST(loose AS INT) END AS lenient_int,
      CASE WHEN loose = floor(loose) THEN CAST(loose AS BIGINT) END AS lenient_long,
      CAST(CAST(loose AS FLOAT) AS DOUBLE) AS lenient_float
    FROM shaped""",
)
oracle("filter_sender", "SELECT event_id, mac, rssi FROM stored WHERE device = 7")
oracle(
    "filter_sender_list",
    """SELECT mac, count(*) AS n,
      device IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 11 = 0) AS allowed
    FROM stored GROUP BY mac, device""",
)
oracle(
    "scenario_summary",
    """SELECT scenario, count(*) AS n, CAST(sum(rssi) AS BIGINT) AS rssi_sum, min(rssi) AS rssi_min, max(rssi) AS rssi_max,
      array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels
    FROM stored GROUP BY scenario""",
)
ORACLE["scenario_summary_by_day"] = ORACLE["scenario_summary"]
LISTED = "SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 101 = 7"
oracle("allowed_senders", f"SELECT event_id, mac, rssi FROM stored WHERE device IN ({LISTED})")
oracle("other_senders", f"SELECT event_id, mac, rssi FROM stored WHERE device NOT IN ({LISTED})")
oracle(
    "parse_lenient_variant",
    """SELECT event_id, CASE WHEN event_id % 89 = 1 THEN 'bad' ELSE CAST(rssi_value AS VARCHAR) END AS rssi, CAST(channel AS VARCHAR) AS channel,
      CAST(11 AS DOUBLE) AS rate, CASE WHEN event_id % 89 <> 1 THEN rssi_value END AS rssi_number
    FROM frames WHERE reason IS NULL OR reason = 'bad_number'""",
)

oracle(
    "tag_sessions",
    """SELECT e.event_id AS arrival, t.session_id, t.captured_at, t.scenario
    FROM events e JOIN session_table t ON t.device = e.user_id AND t.session_date = CAST(e.ts AS DATE)""",
)
oracle(
    "ingest_pipeline",
    """SELECT session_id AS kind, captured_at, scenario, count(*) AS n, count(*) AS arrivals FROM tagged GROUP BY ALL
    UNION ALL SELECT reason, NULL, NULL, count(*), count(*) FROM frames WHERE reason IS NOT NULL GROUP BY reason""",
)
oracle("delete_all", "SELECT event_id, session_date, rssi FROM stored WHERE device % 2 = 1")
oracle("schema_growth", "SELECT event_id, session_date, CASE WHEN device % 2 = 1 THEN rssi END AS rssi FROM stored")
oracle("append_sessions", "SELECT event_id, device, session_date, scenario, rssi, data FROM stored")
oracle("append_all_or_nothing", "SELECT event_id, device, session_date, scenario, rssi FROM stored WHERE device % 2 = 0")
oracle(
    "overwrite_session",
    """SELECT event_id, session_date, scenario, seq, CASE WHEN scenario = 'click' THEN rssi - 100 ELSE rssi END AS rssi
    FROM stored""",
)
oracle("union_profiles", f"SELECT captured_at, scenario, {WIRE} FROM tagged")
oracle(
    "assign_seq",
    """SELECT event_id AS arrival, user_id AS device, CAST(ts AS DATE) AS session_date,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS seq FROM events""",
)
oracle(
    "assign_row_id",
    """SELECT row_number() OVER (ORDER BY session_date, device, event_id) AS id, event_id, device, session_date
    FROM stored""",
)
oracle(
    "first_packet",
    """SELECT device, session_date, event_id, value FROM lines WHERE event_id % 83 <> 2
    QUALIFY row_number() OVER (PARTITION BY device, session_date ORDER BY event_id) = 1""",
)
# Repeats of one command fall within 10 s of each other; equal commands of one device are gathered.
oracle(
    "sessions_parse",
    """, sent AS (
      SELECT device, n, started_at + to_seconds(3 * c) AS ts FROM starts, unnest(range(0, 3)) AS copies(c)
    ), marked AS (
      SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 10 SECOND, true) AS opens FROM sent
      WINDOW w AS (PARTITION BY device, n ORDER BY ts)
    ), numbered AS (
      SELECT *, count(*) FILTER (opens) OVER (PARTITION BY device, n ORDER BY ts) AS run FROM marked
    )
    SELECT device, min(ts) AS started_at, n, true AS clean, count(*) AS repeats FROM numbered GROUP BY device, n, run""",
)
oracle(
    "session_bound",
    """SELECT s.session_id, s.n, count(*) AS packets FROM starts s
    JOIN events e ON e.user_id = s.device AND e.ts >= s.started_at AND e.ts < s.started_at + to_seconds(s.n)
    GROUP BY s.session_id, s.n""",
)
oracle(
    "sessions_without_packets",
    """SELECT s.session_id, s.device, s.started_at, s.n FROM starts s WHERE NOT EXISTS (
      SELECT 1 FROM events e WHERE e.user_id = s.device AND e.ts >= s.started_at AND e.ts < s.started_at + to_seconds(s.n))""",
)
oracle(
    "session_packets",
    """SELECT e.event_id AS arrival, s.device, e.ts, s.session_id FROM starts s
    JOIN events e ON e.user_id = s.device AND e.ts >= s.started_at AND e.ts < s.started_at + to_seconds(s.n)""",
)
oracle(
    "tag_last_start",
    """SELECT e.event_id AS arrival, e.user_id AS device, e.ts, s.session_id, s.started_at, s.n,
      coalesce(e.ts < s.started_at + to_seconds(s.n), false) AS inside
    FROM events e ASOF LEFT JOIN starts s ON e.user_id = s.device AND e.ts >= s.started_at""",
)
oracle(
    "packets_once",
    """SELECT min(event_id) AS arrival, user_id AS device, CAST(ts AS DATE) AS session_date, event_id % 100000 AS seq, arg_min(ts, event_id) AS ts
    FROM events GROUP BY 2, 3, 4""",
)
oracle(
    "progress_5s",
    """SELECT user_id AS device, CAST(ts AS DATE) AS session_date, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS tick,
      count(*) AS packets,
      CAST(sum(count(*)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS in_buffer
    FROM events GROUP BY user_id, CAST(ts AS DATE), time_bucket(INTERVAL 1 HOUR, ts)""",
)

oracle(
    "progress_ticks",
    """SELECT s.session_id, s.started_at + to_seconds(1800 * k) AS tick,
      (SELECT count(*) FROM events e WHERE e.user_id = s.device AND e.ts >= s.started_at
        AND e.ts < s.started_at + to_seconds(1800 * k)) AS in_buffer
    FROM starts s, unnest(range(0, (s.n - 1) // 1800 + 1)) AS t(k)
    WHERE s.started_at + to_seconds(1800 * k) <= (SELECT max(ts) FROM events)""",
)

NUMBERED = ", numbered AS (SELECT *, row_number() OVER (ORDER BY device % 2, session_date, device, event_id) AS id FROM stored)"
oracle("append_numbered", f"{NUMBERED} SELECT id, event_id, device, session_date FROM numbered")
oracle("view_page", f"{NUMBERED} SELECT id, event_id, mac, rssi FROM numbered ORDER BY id DESC LIMIT 50 OFFSET 50")
oracle("view_newest_first", f"SELECT id, captured_at, scenario, {WIRE} FROM tagged ORDER BY id DESC")
CARD = "SELECT id, captured_at, mac, rssi, channel || ' (' || secondary_channel || ')' AS channel FROM tagged"
oracle("view_newest_100", f"{CARD} ORDER BY id DESC LIMIT 100")
oracle("view_card", CARD)
oracle("view_count", "SELECT count(*) AS n FROM stored")
oracle("csv_roundtrip", f"SELECT event_id, {WIRE} FROM stored")
# The mobile layout (odd ids here) stores stamps by the second, the desktop one as they are.
STAMP = "CASE WHEN id % 2 = 1 THEN date_trunc('second', captured_at) ELSE captured_at END AS captured_at"
oracle("collector_roundtrip", f"SELECT id, {STAMP}, scenario, {WIRE} FROM tagged")
oracle("collector_newest_first", f"SELECT id, {STAMP}, scenario, mac, rssi FROM tagged ORDER BY id DESC LIMIT 100")

oracle(
    "discovery_first",
    """SELECT device, to_timestamp(epoch_us(ts) // 75000000 * 75)::TIMESTAMP AS listen_from, min(ts) AS ts,
      arg_min(address, struct_pack(ts := ts, address := address)) AS address
    FROM announcements WHERE announces GROUP BY device, epoch_us(ts) // 75000000""",
)
oracle(
    "discovery_listen",
    """, listening AS (SELECT event_id AS listen_id, user_id AS device, ts AS listen_from FROM events WHERE event_type = 'click'),
    heard AS (
      SELECT a.device, a.ts, a.address, l.listen_id, l.listen_from FROM (SELECT * FROM announcements WHERE announces) a
      ASOF JOIN listening l ON a.device = l.device AND a.ts >= l.listen_from
    )
    SELECT listen_id, device, listen_from, min(ts) AS ts, arg_min(address, struct_pack(ts := ts, address := address)) AS address
    FROM heard WHERE ts < listen_from + INTERVAL 4 HOUR GROUP BY listen_id, device, listen_from""",
)
oracle(
    "discovery_latest",
    """SELECT device, ts AS seen_at, address FROM announcements WHERE announces
    QUALIFY row_number() OVER (PARTITION BY device ORDER BY ts DESC, address DESC) = 1""",
)
oracle(
    "discovery_dedup",
    """, marked AS (
      SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 20 SECOND, true) AS opens FROM announcements WHERE announces
      WINDOW w AS (PARTITION BY device, address ORDER BY ts)
    ), numbered AS (
      SELECT *, count(*) FILTER (opens) OVER (PARTITION BY device, address ORDER BY ts) AS run FROM marked
    )
    SELECT device, address, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS copies
    FROM numbered GROUP BY device, address, run""",
)
oracle(
    "route_counts",
    """SELECT route, count(*) AS n FROM (
      SELECT CASE WHEN event_id % 83 = 2 THEN 'discovery' ELSE 'packet' END AS route FROM events
      UNION ALL SELECT CASE WHEN announces THEN 'discovery' ELSE 'other' END FROM announcements
      UNION ALL SELECT 'start' FROM events WHERE event_type = 'signup') GROUP BY route""",
)
oracle(
    "failure_streaks",
    """, links AS (
      SELECT user_id, event_id, event_type = 'error' AS failed,
        count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
      FROM events WHERE event_type IN ('error', 'signup')
    ), runs AS (
      SELECT user_id, run, count(*) FILTER (failed) AS failures FROM links GROUP BY user_id, run
    )
    SELECT user_id, max(failures) AS max_streak, CAST(sum(failures // 5) AS BIGINT) AS hits FROM runs GROUP BY user_id""",
)

oracle("users_all", "SELECT id, nome, apelido, status FROM users")
oracle("users_count", "SELECT count(*) AS n, count(*) = 0 AS is_empty FROM users")
oracle(
    "users_valid",
    """SELECT id, CASE WHEN id % 10 = 0 THEN ' ' || chr(9) ELSE nome END AS nome, apelido,
      CASE WHEN id % 10 = 0 THEN 'nome' ELSE '' END AS missing FROM users""",
)
oracle(
    "user_status_label",
    "SELECT id, nome, CASE WHEN status = 0 THEN 'Inativo' ELSE 'Ativo' END AS status_label FROM users",
)
oracle(
    "users_apply_changes",
    """, existing AS (
      SELECT * FROM users UNION ALL SELECT id, 'new', 'new', 2 FROM changes WHERE op = 'I'
    ), latest AS (
      SELECT id, op, status FROM changes WHERE op <> 'D'
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, nr DESC) = 1
    )
    SELECT e.id, e.nome, e.apelido, coalesce(l.status, e.status) AS status FROM existing e LEFT JOIN latest l ON l.id = e.id
    WHERE NOT EXISTS (SELECT 1 FROM changes d WHERE d.id = e.id AND d.op = 'D')""",
)
ORACLE["users_merge_bucketed"] = ORACLE["users_apply_changes"]
oracle(
    "users_change_report",
    """, dated AS (
      SELECT c.*, count(*) FILTER (op = 'D') OVER (PARTITION BY id ORDER BY changed_at, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone
      FROM changes c
    )
    SELECT op, count(*) FILTER (gone = 0 AND (op = 'I' OR id IN (SELECT id FROM users))) AS applied,
      count(*) FILTER (NOT (gone = 0 AND (op = 'I' OR id IN (SELECT id FROM users)))) AS unmatched
    FROM dated GROUP BY op""",
)
oracle(
    "entity_text",
    "SELECT id, 'ID: ' || id || ', Nome: ' || nome || ', Apelido: ' || apelido || ', Status: ' || status AS entity FROM users",
)
oracle(
    "survey_text",
    """SELECT id, 'ID: ' || id || ', Descrição: Sala ' || id || ', Largura: ' || (width / 2.0::DOUBLE) || ', Comprimento: ' ||
        CAST(length AS DOUBLE) || ', Status: 1' AS entity FROM rooms
    UNION ALL
    SELECT r.id, 'ID: ' || (y.y * r.width + x.x + 1) || ', Ambiente ID: ' || r.id || ', Número: ' || (y.y * r.width + x.x + 1) ||
      ', Posição X: ' || (x.x / 4.0::DOUBLE) || ', Posição Y: ' || CAST(y.y AS DOUBLE) || ', Status: 0'
    FROM rooms r, unnest(range(0, r.width)) AS x(x), unnest(range(0, r.length)) AS y(y)""",
)
oracle(
    "grid_points",
    """SELECT r.id AS room_id, CAST(y.y * r.width + x.x + 1 AS INT) AS numero, CAST(x.x AS INT) AS x, CAST(y.y AS INT) AS y
    FROM rooms r, unnest(range(0, r.width)) AS x(x), unnest(range(0, r.length)) AS y(y)""",
)
oracle(
    "points_with_room",
    """SELECT r.id AS room_id, CAST(i.i AS INT) AS numero, i.i / 2.0::DOUBLE AS x, CAST(i.i * r.length AS DOUBLE) AS y, r.width, r.length
    FROM rooms r, unnest(range(1, r.width + 1)) AS i(i)""",
)

oracle(
    "scalar_texts",
    """SELECT event_id, '02:00:00:00:' || lower(lpad(to_hex(user_id // 256), 2, '0')) || ':' || lower(lpad(to_hex(user_id % 256), 2, '0')) AS mac,
      CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS desktop_stamp,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS mobile_stamp, ts AS desktop_read, date_trunc('second', ts) AS mobile_read,
      CAST(CASE event_id % 7 WHEN 2 THEN -(event_id % 100) WHEN 0 THEN event_id % 100 WHEN 1 THEN event_id % 100
        WHEN 5 THEN event_id % 100 ELSE 0 END AS INT) AS seconds
    FROM events""",
)
oracle(
    "payload_text_roundtrip",
    """SELECT vec_id, '[' || array_to_string(payload, ',') || ']' AS data, CAST(len(payload) AS INT) AS n,
      CAST(list_sum(payload) AS BIGINT) AS total FROM payloads""",
)

oracle(
    "payload_long",
    """, long AS (SELECT scenario, CAST(i AS INT) AS idx, payload[i + 1] AS value FROM stored, unnest(range(0, 128)) AS t(i))
    SELECT scenario, idx, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, min(value) AS low, max(value) AS high
    FROM long GROUP BY scenario, idx""",
)
oracle("payload_integrity", "SELECT event_id, len - 64 AS len, 128 AS found FROM stored WHERE device % 9 = 0")
oracle(
    "magnitude_by_index",
    """, long AS (
      SELECT scenario, CAST(i AS INT) AS pair,
        CAST(floor(sqrt(CAST(payload[2 * i + 1] * payload[2 * i + 1] + payload[2 * i + 2] * payload[2 * i + 2] AS DOUBLE)) * 1000) AS BIGINT) AS milli
      FROM stored, unnest(range(2, 64)) AS t(i))
    SELECT scenario, pair, count(*) AS n, CAST(sum(milli) AS BIGINT) AS milli, max(milli) AS peak FROM long GROUP BY scenario, pair""",
)
oracle(
    "seq_gaps",
    """, stepped AS (
      SELECT device, session_date, seq - lag(seq) OVER (PARTITION BY device, session_date ORDER BY event_id) AS step FROM stored)
    SELECT device, session_date, count(*) AS n, CAST(coalesce(sum(step - 1) FILTER (step > 1), 0) AS BIGINT) AS missing,
      count(*) FILTER (step = 0) AS repeated, count(*) FILTER (step < 0) AS backward
    FROM stepped GROUP BY device, session_date""",
)
oracle(
    "interarrival",
    """, stepped AS (
      SELECT device, session_date,
        (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device, session_date ORDER BY event_id))) % 4294967296 AS step FROM stored)
    SELECT device, session_date, count(*) AS steps, min(step) AS min_step, max(step) AS max_step,
      CAST(sum(step) AS BIGINT) AS total_step, count(*) FILTER (step > 10000) AS late
    FROM stepped WHERE step IS NOT NULL GROUP BY device, session_date""",
)

# --- streams: the stored outcome equals the batch result ---

oracle("stream_ingest", f"SELECT scenario, {WIRE} FROM stored")
oracle(
    "stream_route_counts",
    """SELECT route, count(*) AS n FROM (
      SELECT CASE WHEN event_id % 83 = 2 THEN 'discovery' WHEN reason IS NULL THEN 'packet' ELSE 'reject' END AS route FROM frames
      UNION ALL SELECT CASE WHEN announces THEN 'discovery' ELSE 'other' END FROM announcements
      UNION ALL SELECT 'start' FROM events WHERE event_type = 'signup') GROUP BY route""",
)
oracle("stream_pipeline", "SELECT session_id, captured_at, scenario, count(*) AS n FROM tagged GROUP BY ALL")
ORACLE["stream_progress"] = ORACLE["progress_5s"]
ORACLE["stream_discovery_dedup"] = ORACLE["discovery_dedup"]
ORACLE["stream_reject_counts"] = ORACLE["reject_reasons"]
ORACLE["stream_failure_streaks"] = ORACLE["failure_streaks"]
# One session at a time: the next session of a device is its first start at or after the last end.
ORACLE["stream_session_timer"] = FRAMES.replace("WITH payloads", "WITH RECURSIVE payloads", 1) + """, ran AS (
      SELECT device, session_id, epoch_us(started_at) AS started, epoch_us(started_at) + n * 1000000::BIGINT AS ends FROM starts
      QUALIFY row_number() OVER (PARTITION BY device ORDER BY started_at, session_id) = 1
      UNION ALL
      SELECT device, session_id, started, ends FROM (
        SELECT s.device, s.session_id, epoch_us(s.started_at) AS started, epoch_us(s.started_at) + s.n * 1000000::BIGINT AS ends,
          row_number() OVER (PARTITION BY s.device ORDER BY s.started_at, s.session_id) AS nr
        FROM ran r JOIN starts s ON s.device = r.device AND epoch_us(s.started_at) >= r.ends) WHERE nr = 1
    )
    SELECT r.session_id, r.device, make_timestamp(r.started) AS started_at, make_timestamp(r.ends) AS ends_at, count(e.event_id) AS packets
    FROM ran r LEFT JOIN events e ON e.user_id = r.device AND epoch_us(e.ts) >= r.started AND epoch_us(e.ts) < r.ends
    GROUP BY ALL"""
ORACLE["stream_session_ends"] = f"SELECT * FROM ({ORACLE['stream_session_timer']}) WHERE ends_at <= (SELECT max(ts) FROM events)"
ORACLE["stream_session_packets"] = ORACLE["session_packets"]
oracle("stream_datagrams", "SELECT event_id AS arrival, ts AS arrived, value FROM lines")
ORACLE["stream_packets_once"] = ORACLE["packets_once"]
