"""Record layouts shared by every job: wire order, stored order, dimension tables."""

from __future__ import annotations

# The 25 wire fields in wire order, with the stored type of each.
WIRE_FIELDS: list[tuple[str, str]] = [
    ("type", "string"),
    ("seq", "int"),
    ("mac", "string"),
    ("rssi", "int"),
    ("rate", "float"),
    ("sig_mode", "int"),
    ("mcs", "int"),
    ("bandwidth", "int"),
    ("smoothing", "int"),
    ("not_sounding", "int"),
    ("aggregation", "int"),
    ("stbc", "int"),
    ("fec_coding", "int"),
    ("sgi", "int"),
    ("noise_floor", "int"),
    ("ampdu_cnt", "int"),
    ("channel", "int"),
    ("secondary_channel", "int"),
    ("local_timestamp", "bigint"),
    ("ant", "int"),
    ("sig_len", "int"),
    ("rx_state", "int"),
    ("len", "int"),
    ("first_word", "int"),
    ("data", "string"),
]

# Message tags on the wire.
PACKET_TAG = "CSI_DATA"
DISCOVERY_TAG = "CSI_IP,"
START_TAG = "start,"

WIRE_NAMES = [name for name, _ in WIRE_FIELDS]
NUMERIC_FIELDS = [(name, kind) for name, kind in WIRE_FIELDS if kind != "string"]

_WIRE_DDL = ", ".join(f"`{name}` {kind}" for name, kind in WIRE_FIELDS)
CSI_DDL = f"id bigint, captured_at timestamp_ntz, scenario string, {_WIRE_DDL}"

USERS_DDL = "id bigint, nome string, apelido string, status int"

# The two stored layouts name the session columns differently.
STORED_NAMES = {
    "desktop": {"captured_at": "timestamp", "scenario": "scenario"},
    "mobile": {"captured_at": "data_hora", "scenario": "cenario"},
}

# Device clock: unsigned 32-bit counter of microseconds; nominal packet spacing at 100 Hz.
CLOCK_MODULUS = 1 << 32
NOMINAL_INTERVAL_MICROS = 1_000_000 // 100
