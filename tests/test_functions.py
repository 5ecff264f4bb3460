import sqlite3

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from csilake.functions import numbers, text

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, values, kind, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"nr int, v {kind}")
    return [tuple(r)[1:] for r in rows.select("nr", *columns).orderBy("nr").collect()]


@QUICK
@given(st.lists(st.binary(max_size=12) | st.text(max_size=6).map(lambda s: s.encode("utf-8", "ignore") + b"\xff\xc3"), min_size=1, max_size=40))
def test_decode_matches_python(spark, values):
    values += ["a�b".encode() + b"\xff", "\U0010ffff�".encode() + b"\x80", b"\xe2\x28\xa1", b"\xf0\x9f\x98"]
    found = one(
        spark, values, "binary", text.decode_bytes(F.col("v"), "desktop").alias("a"), text.decode_bytes(F.col("v"), "mobile").alias("b")
    )
    for value, (dropped, replaced) in zip(values, found):
        assert dropped == value.decode("utf-8", "ignore")
        assert replaced == value.decode("utf-8", "replace")


def test_trim_matches_both_platforms(spark):
    samples = [" a ", "\t\na\x0b", " a ", "\x00a\x1b", "a b", ""]
    found = one(spark, samples, "string", text.trim_line(F.col("v"), "desktop"), text.trim_line(F.col("v"), "mobile"))
    low = "".join(map(chr, range(33)))
    assert found == [(s.strip(), s.strip(low)) for s in samples]


def test_lenient_numbers_match_column_affinity(spark):
    samples = [
        "5.0", "+5", " 5 ", "", "abc", "2147483647", "2147483648", "1f", "5.", ".5", "1e2", "5.5", "0x10", "\t7\n", "1e400", "-0",
        "9223372036854775807", "9223372036854775808", "NaN", "inf", "5e", "1_0", "\x0b7", "7 ", "- 5", "00012", "1e-2", "100e-2", "-1e3",
    ]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (i INTEGER, r REAL)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(s, s) for s in samples])
    stored = db.execute("SELECT i, r FROM t ORDER BY rowid").fetchall()
    found = one(spark, samples, "string", numbers.lenient_int(F.col("v"), "bigint"), numbers.lenient_int(F.col("v")), numbers.lenient_float(F.col("v")).cast("double"))
    for sample, (i, r), (long, short, real) in zip(samples, stored, found):
        whole = i if isinstance(i, int) else None
        assert long == whole, sample
        assert short == (whole if whole is not None and -(2**31) <= whole < 2**31 else None), sample
        if isinstance(r, str):
            assert real is None, sample
        elif r != float("inf"):
            assert abs(real - r) <= abs(r) * 1e-6, sample


def test_leading_int(spark):
    samples = ["60", " 60", "60s", "+7", "-3", "abc", "", "1.9", "99999999999", "\n5"]
    found = one(spark, samples, "string", numbers.leading_int(F.col("v")), numbers.digits_only(F.col("v")))
    assert [f[0] for f in found] == [60, 60, 60, 7, -3, 0, 0, 1, 0, 5]
    assert [f[1] for f in found] == [True, False, False, False, False, False, True, False, True, False]


def test_labels_and_entities(spark):
    assert one(spark, [0, 1, 2, None], "int", text.status_label(F.col("v"))) == [("Inativo",), ("Ativo",), ("Ativo",), ("Ativo",)]
    assert one(spark, ["", None, "walk"], "string", text.scenario_or_default(F.col("v"))) == [("N/A",), ("N/A",), ("walk",)]
    entity = one(
        spark, [1], "int",
        text.user_text(F.col("v"), F.lit("Ana"), F.lit("a"), F.lit(0)),
        text.room_text(F.col("v"), F.lit("Lab"), F.lit(2.5), F.lit(4.0), F.lit(1)),
        text.point_text(F.col("v"), F.lit(7), F.lit(3), F.lit(0.5), F.lit(1.0), F.lit(1)),
    )[0]
    assert entity == (
        "ID: 1, Nome: Ana, Apelido: a, Status: 0",
        "ID: 1, Descrição: Lab, Largura: 2.5, Comprimento: 4.0, Status: 1",
        "ID: 1, Ambiente ID: 7, Número: 3, Posição X: 0.5, Posição Y: 1.0, Status: 1",
    )


def test_small_texts(spark):
    assert one(spark, [[148, 217, 179, 128, 140, 1]], "array<bigint>", text.mac_text(F.col("v"))) == [("94:d9:b3:80:8c:01",)]
    assert one(spark, ["CSI_IP,10.0.0.1,x"], "string", text.second_part(F.col("v"))) == [("10.0.0.1",)]
    assert one(spark, ["0 - a-b "], "string", text.after_first_dash(F.col("v"))) == [("a-b",)]
    assert one(spark, [13], "int", text.channel_text(F.col("v"), F.lit(2))) == [("13 (2)",)]
