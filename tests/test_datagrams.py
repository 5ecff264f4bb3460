"""Datagram logs: byte ranges find their records, batches are limited, restarts repeat nothing."""

import datetime as dt
import os
import random

import pytest

from csilake.sources import datagrams
from csilake.sources.datagrams import PAYLOAD, DatagramLog, Range, read_range, record


def payloads(rng, n):
    """Of all lengths, with marks and whole records inside, and empty ones."""
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(60)))
        out.append({0: b"", 1: datagrams.MARK * rng.randrange(1, 5), 2: record(body, 5) + body, 3: bytes(PAYLOAD)}.get(kind, body))
    return out


def read(path, cuts):
    found = []
    for low, high in zip(cuts, cuts[1:]):
        for batch in read_range(Range(path, low, high)):
            found += zip(batch.column("position").to_pylist(), batch.column("value").to_pylist())
    return found


@pytest.mark.parametrize("piece", [1 << 20, 8000])
def test_each_record_is_in_one_range(folder, monkeypatch, piece):
    monkeypatch.setattr(datagrams, "PIECE", piece)
    rng = random.Random(piece)
    sent = payloads(rng, 300)
    path = f"{folder}/a.log"
    with open(path, "wb") as out:
        for body in sent:
            out.write(record(body, rng.randrange(10**15)))
    size = os.path.getsize(path)
    for n in (0, 1, 3, 40):
        cuts = [0, *sorted(rng.randrange(size) for _ in range(n)), size]
        assert [v for _, v in sorted(read(path, cuts))] == sent
    every = list(range(0, size, 97)) + [size]
    assert [v for _, v in sorted(read(path, every))] == sent


def test_damaged_and_unfinished_records(folder):
    path = f"{folder}/a.log"
    whole = [record(b"one", 1), record(b"two" * 9, 2), record(b"three", 3)]
    broken = bytearray(whole[1])
    broken[-1] ^= 1
    assert datagrams.MARK not in record(datagrams.MARK * 5, int.from_bytes(datagrams.MARK + datagrams.MARK[:3], "little"))[1:]
    with open(path, "wb") as out:
        out.write(b"noise" + whole[0] + bytes(broken) + datagrams.MARK + whole[2][:-2])
    size = os.path.getsize(path)
    assert [v for _, v in read(path, [0, size])] == [b"one"]
    with open(path, "ab") as out:
        out.write(whole[2][-2:] + whole[0])
    # what was unfinished belongs to the range of its last byte
    assert [v for _, v in read(path, [0, size, os.path.getsize(path)])] == [b"one", b"three", b"one"]
    with pytest.raises(ValueError, match="at most"):
        record(bytes(PAYLOAD + 1), 0)


def test_limited_batches_over_restarts(spark, folder):
    """Files of several ranges grow between starts; every record is stored once."""
    spark.dataSource.register(DatagramLog)
    rng, sent = random.Random(1), []
    os.makedirs(f"{folder}/logs")

    def grow(name, n, cut=0):
        with open(f"{folder}/logs/{name}", "ab") as out:
            for _ in range(n):
                body = f"{len(sent)}".encode() + bytes(rng.randrange(400))
                sent.append(body)
                out.write(record(body, len(sent)))
        if cut:
            with open(f"{folder}/logs/{name}", "rb+") as out:
                out.seek(-cut, os.SEEK_END)
                rest = out.read()
                out.seek(-cut, os.SEEK_END)
                out.truncate()
            return rest

    def run():
        rows = spark.readStream.format("datagram_log").options(state=f"{folder}/state/planned.json", bytes_per_trigger="30000", bytes_per_split="9000").load(f"{folder}/logs")
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").start()
        query.processAllAvailable()
        added = [p["numInputRows"] for p in query.recentProgress]
        query.stop()
        return added

    grow("a.log", 200)
    rest = grow("b.log", 200, cut=100)
    assert len([n for n in run() if n]) >= 3  # of 30,000 bytes each
    with open(f"{folder}/logs/b.log", "ab") as out:
        out.write(rest)
    grow("a.log", 50)
    run()
    assert sum(run()) == 0
    grow("c.log", 20)
    run()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(bytes(r.value) for r in rows) == sorted(sent)
    assert {r.arrived for r in rows} == {dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=i + 1) for i in range(len(sent))}
    assert spark.read.format("datagram_log").option("bytes_per_split", 5000).load(f"{folder}/logs").count() == len(sent)
