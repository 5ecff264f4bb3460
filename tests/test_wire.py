import random

import pytest
from pyspark.sql import functions as F

from csilake.functions.payload import payload_text
from csilake.operators import wire
from csilake.operators.signal import magnitude_long, payload_integrity
from csilake.schema import NUMERIC_FIELDS, WIRE_NAMES
from samples import SAMPLE, frame, line


def parse(spark, lines, profile="strict"):
    rows, rejects = wire.parse_lines(frame(spark, lines), profile)
    return {r["nr"]: r for r in rows.collect()}, {r["nr"]: r["reason"] for r in rejects.collect()}


@pytest.mark.parametrize("profile", ["strict", "lenient"])
def test_sample_packet(spark, profile):
    rows, rejects = parse(spark, [SAMPLE, "C"], profile)
    row = rows[0]
    assert rejects == {1: "prefix"}
    assert (row["type"], row["seq"], row["mac"], row["rssi"], row["rate"]) == ("CSI_DATA", 0, "94:d9:b3:80:8c:81", -30, 11.0)
    assert (row["noise_floor"], row["channel"], row["secondary_channel"], row["local_timestamp"]) == (-93, 13, 2, 2751923)
    assert row["len"] == len(row["payload"]) == 128
    assert row["payload"][:4] == [67, 48, 4, 0]
    assert row["data"] == SAMPLE.split('"')[1]
    assert row["bad_fields"] == []
    pairs = [(row["payload"][2 * i], row["payload"][2 * i + 1]) for i in (2, 3, 4, 60, 61, 62, 63)]
    assert set(pairs) == {(0, 0)}


def test_fourteen_packets(spark):
    clocks = [2751923 + round(i * 184311 / 13) for i in range(14)]
    rows, rejects = parse(spark, [line(i, local_timestamp=str(c)) for i, c in enumerate(clocks)])
    assert not rejects
    assert [rows[i]["seq"] for i in range(14)] == list(range(14))
    assert (rows[0]["local_timestamp"], rows[13]["local_timestamp"]) == (2751923, 2936234)


# text: (strict int, strict float, lenient int, lenient float); None rejects or marks the field
TEXTS = {
    "5": (5, 5.0, 5, 5.0),
    "5.0": (None, 5.0, 5, 5.0),
    "+5": (5, 5.0, 5, 5.0),
    " 5 ": (5, 5.0, 5, 5.0),
    "": (None, None, None, None),
    "abc": (None, None, None, None),
    "2147483648": (None, 2147483648.0, None, 2147483648.0),
    "-2147483648": (-2147483648, -2147483648.0, -2147483648, -2147483648.0),
    "1f": (None, 1.0, None, None),
    '"5"': (5, 5.0, None, None),
    '" 5"': (None, 5.0, None, None),
    "5.5": (None, 5.5, None, 5.5),
    "1e2": (None, 100.0, 100, 100.0),
    "0x10": (None, None, None, None),
    "inf": (None, None, None, None),
    "000000000012": (12, 12.0, 12, 12.0),
}


@pytest.mark.parametrize("profile", ["strict", "lenient"])
def test_every_numeric_field_by_profile(spark, profile):
    cases = [(name, kind, text) for name, kind in NUMERIC_FIELDS for text in TEXTS]
    rows, rejects = parse(spark, [line(**{name: text}) for name, kind, text in cases], profile)
    for nr, (name, kind, text) in enumerate(cases):
        position = {"strict": 0, "lenient": 2}[profile] + (kind == "float")
        expected = TEXTS[text][position]
        if kind == "bigint" and text == "2147483648":
            expected = 2147483648
        if expected is None and profile == "strict":
            assert rejects.get(nr) == "bad_number", (name, text)
        else:
            assert rows[nr][name] == expected, (name, text)
            assert rows[nr]["bad_fields"] == ([name] if expected is None else []), (name, text)


def test_reject_reasons_in_order(spark):
    lines = [
        SAMPLE,
        "CSI_IP,1,2",
        "CSI_DATA,1,2",
        SAMPLE.rsplit(',"', 1)[0],
        line(rssi="bad"),
        "X" + line(rssi="bad"),
        line(type="CSI_DATAX"),
        None,
    ]
    rows, rejects = parse(spark, lines)
    assert rejects == {1: "prefix", 2: "field_count", 3: "field_count", 4: "bad_number", 5: "prefix"}
    assert set(rows) == {0, 6}
    # The prefix test lets a longer tag pass; only the lenient profile stores it.
    assert rows[6]["type"] == "CSI_DATA"
    lenient, _ = parse(spark, lines, "lenient")
    assert lenient[6]["type"] == "CSI_DATAX"
    assert lenient[4]["rssi"] is None and lenient[4]["raw"] == lines[4]


@pytest.mark.parametrize(
    "data, strict, lenient, payload",
    [
        ('"[1,2', "[1,2", "[1,2", None),
        ('"[1,x]"', "[1,x]", "[1,x]", None),
        ('""[1,2]""', "[1,2]", "[1,2]", [1, 2]),
        (' "[1,2]" ', "[1,2]", ' "[1,2]" ', [1, 2]),
        ('"[1,"2"]"', "[1,2]", '[1,"2"]', None),
        ("[1,2]", "[1,2]", "[1,2]", [1, 2]),
        ("", "", "", None),
    ],
)
def test_data_field(spark, data, strict, lenient, payload):
    for profile, expected in (("strict", strict), ("lenient", lenient)):
        rows, _ = parse(spark, [line(data=data)], profile)
        assert rows[0]["data"] == expected
        if profile == "strict":
            assert rows[0]["payload"] == (payload if data != '"[1,"2"]"' else [1, 2])


@pytest.mark.parametrize("profile", ["strict", "lenient"])
def test_plain_and_checked_lines_agree(spark, profile):
    """A blank around one number sends the line down the checked path; nothing else may change."""
    rng = random.Random(7)
    plain = [line(i, rssi=str(rng.randint(-99, 0)), rate=f"{rng.random() * 50:.2f}") for i in range(40)]
    checked = [text.replace(",13,2,", ", 13 ,2,") for text in plain]
    fast, _ = parse(spark, plain, profile)
    slow, _ = parse(spark, checked, profile)
    for nr in fast:
        assert [fast[nr][c] for c in WIRE_NAMES] == [slow[nr][c] for c in WIRE_NAMES]


def test_render_then_parse_is_identity(spark):
    rng = random.Random(11)
    columns = "nr int, " + ", ".join(f"`{n}` {k}" for n, k in [("seq", "int"), ("mac", "string")] + NUMERIC_FIELDS[1:])
    records = []
    for nr in range(200):
        record = [nr, rng.randint(-(2**31), 2**31 - 1), ":".join(f"{rng.randrange(256):02x}" for _ in range(6))]
        for name, kind in NUMERIC_FIELDS[1:]:
            record.append(
                float(rng.randint(-1000, 1000)) / 4 if kind == "float"
                else rng.randint(0, 2**32 - 1) if kind == "bigint" else rng.randint(-(2**31), 2**31 - 1)
            )
        records.append((*record, [rng.randint(-128, 127) for _ in range(rng.randrange(0, 130))]))
    typed = spark.createDataFrame(records, columns + ", payload array<int>").withColumn("type", F.lit("CSI_DATA"))
    fields = {n: F.col(n) for n in WIRE_NAMES[:-1]}
    lines = typed.select("nr", wire.render_line(fields, payload_text(F.col("payload"))).alias("value"))
    rows, rejects = wire.parse_lines(lines)
    assert rejects.count() == 0
    names = ["nr", *WIRE_NAMES[:-1], "payload"]
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(map(tuple, typed.select(*names).collect()))


def test_payload_integrity_and_magnitudes(spark):
    rows, _ = wire.parse_lines(
        frame(spark, [line(data='"[9,9,9,9,3,4,6,8]"', len="8"), line(data='"[3,4]"', len="3", first_word="0"), line(data='"[1,2', len="2")])
    )
    assert sorted(r["nr"] for r in payload_integrity(rows).collect()) == [1, 2]
    found = sorted(map(tuple, magnitude_long(rows, "nr").collect()))
    assert found == [(0, 2, 5.0), (0, 3, 10.0), (1, 0, 5.0)]
