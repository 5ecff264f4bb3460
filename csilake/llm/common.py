"""What several operators share: whole texts as byte buffers, vectorised words and hashes, row clean-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import csilake
from csilake.session import new_folder

#: Bytes of text that a task works on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Bytes of words: all but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words: ASCII letters a-z, digits 0-9 and what lies above ASCII.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True


def ship(spark: SparkSession) -> None:
    """The functions of this package travel with the tasks; workers need not have it installed."""
    cloudpickle.register_pickle_by_value(csilake)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text of each row alone (further columns can't clash); a null text is empty."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until the frame has none of them in any spelling: columns of an operator's own beside all of the caller's."""
    taken = {x.lower() for x in frame.columns}
    return [next(x for x in (name + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken) for name in names]


def dealt(docs: DataFrame, chunk_bytes: int, spread: int = 4) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) of all rows, dealt by a hash to chunks of about ``chunk_bytes``, ``spread`` a shuffle partition at least; and the bytes of all texts.

    Equal rows of one split meet in a chunk; those of different splits are dealt apart.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = texts(docs)
    total = own.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = max(spread * partitions, -(-total // chunk_bytes))
    number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks))
    return own.select(number.alias("chunk"), "doc_id", "text").repartition(partitions, "chunk"), total


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def lowest(frame: DataFrame, hashed: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows: those of least hash, then least key, whatever the partitions.

    A bar on the hash that some 4 * limit rows pass is set from the row count first, so tasks don't send ``limit`` rows each.
    """
    n = frame.count()
    share = min(1.0, 4 * limit / max(n, 1))
    bar = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    order = frame.withColumn("_lowest", F.xxhash64(*hashed))
    return order.filter(F.col("_lowest") <= F.lit(min(bar, (1 << 63) - 1))).orderBy("_lowest", *hashed).limit(limit).drop("_lowest")


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``limit`` bytes of text; a longer text stands alone."""
    sizes = np.diff(offsets(batch.column(column)))
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield start, batch.num_rows


def offsets(column: pa.Array) -> np.ndarray:
    """Start of each text in the column's bytes, and the end of the last one."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    found = np.frombuffer(column.buffers()[1], dtype=kind, count=column.offset + len(column) + 1)
    return found[column.offset :].astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, one after the other, and where each starts (one end more)."""
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: near values get far results."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "up" not in _CACHE or len(_CACHE["up"]) < n:
        n = 1 << max(12, n.bit_length())
        _CACHE["up"], _CACHE["down"] = _powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n)
        _CACHE["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    return _CACHE["up"], _CACHE["down"], _CACHE["byte"]


def ranges_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: equal bytes, equal hash, wherever they stand."""
    up, down, values = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, A-Z lower-cased: the bytes, word starts, word ends, hashes, first word of each text (one end more)."""
    data, at = raw(column)
    data = lowered(data)
    start, end, first = word_places(data, at, inside)
    return data, start, end, word_hashes(data, start, end), first


def word_places(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts that start at ``at`` (one end more), and the first word of each text (one end more)."""
    is_in = inside[data]
    before = np.empty(len(data), dtype=bool)
    before[1:] = is_in[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    start = np.flatnonzero(is_in & ~before)
    after = np.empty(len(data), dtype=bool)
    after[:-1] = is_in[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    end = np.flatnonzero(is_in & ~after) + 1
    return start, end, np.searchsorted(start, at)


#: Bytes above which a word is hashed by itself.
_LONG = 4096
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [_MASK], dtype=np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes a step through the finalizer, so no pair of words collides by its structure."""
    size = end - start
    value = mix(size.astype(np.uint64) + np.uint64(_ODD))
    if not len(start):
        return value
    padded = np.append(data, np.zeros(8, np.uint8))
    wide = np.lib.stride_tricks.as_strided(np.frombuffer(padded, dtype=np.uint64, count=1), (len(data) + 1,), (1,))
    row, done = np.arange(len(start)), 0
    while len(row):
        left = size[row] - done
        block = wide[start[row] + done] & _BELOW[np.minimum(left, 8)]
        value[row] = mix(value[row] * np.uint64(0xD6E8FEB86659FD93) + block)
        done += 8
        row = row[(left > 8) & (size[row] <= _LONG)]
    for i in np.flatnonzero(size > _LONG).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return value
