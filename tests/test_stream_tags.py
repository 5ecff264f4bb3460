"""Packets of a stream are tagged without moving their payload text twice."""

from pyspark.sql import functions as F

from csilake.operators import wire
from csilake.sources import landed
from csilake.streaming import ingest
from samples import frame, line


def test_tags_are_added_without_the_payload_text(spark, folder):
    lines = [line(0), line(1, data='" [1,2] "'), line(2, data="[3]"), line(3, data='"[4, ""5""]"'), line(4, rssi="x"), line(5, type="CSI_DATA2", data="")]
    for profile in ("strict", "lenient"):
        landed.land_lines(frame(spark, lines), f"{folder}/{profile}")
        seen = []

        def tag(rows):
            seen.append(rows.columns)
            return rows.withColumn("session_id", F.lit(7))

        stream = ingest.read_line_stream(spark, f"{folder}/{profile}")
        ingest.start_ingest(stream, f"{folder}/{profile}-t", f"{folder}/{profile}-c", profile, tag=tag).awaitTermination()
        want = wire.accepted(wire.classify_lines(frame(spark, lines), profile)).select("seq", "data", "raw")
        got = spark.read.parquet(f"{folder}/{profile}-t")
        assert sorted(map(str, got.select("seq", "data", "raw").collect())) == sorted(map(str, want.collect()))
        assert "data" not in seen[0] and got.columns[-2] == "session_id" and got.where("session_id <> 7").count() == 0
