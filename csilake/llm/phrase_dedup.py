"""Removal of word sequences that an earlier document has, by level-wise doubling.

A window is WINDOW words in a row of one document; every word of a window that also starts in a document of smaller id goes. Windows are
not compared at once. Level one looks at sequences of half the length: of those in a window the one of least hash is the
window's seed, so equal windows have equal seeds at one place. Seeds that stand in one document only are dropped with all
their windows. Level two extends the others to the full length: windows in a row with one seed are a run, and a run that an
earlier document has as a whole is decided. Of the rest only runs that share a seed and differ are candidates still; level three
takes their windows one by one. A level without candidates has no rows, and neither have those after it.

Texts are dealt once to chunks of some CHUNK_BYTES by a hash, and each level reads that shuffle again. A chunk tells the others of a
sequence once, with its least document, so what a sequence found in very many documents costs is one row a chunk.
What a level finds goes back to the chunks that asked. Equality of runs is that of two 64-bit hashes (seed and run), of windows
that of 96 bits.

A null text has no words. Rows may repeat; a document of no smaller id is no reason to remove. Rows of one id and different texts
don't see each other; null ids come last and don't see each other. An empty table gives no rows. Further columns are ignored. A very long text is a chunk of its
own size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from csilake.llm.common import SPACED, mix, raw, table, texts, word_hashes, word_places

WINDOW = 13
#: Bytes of text of a chunk, about.
CHUNK_BYTES = 4 << 20
#: Chunks a shuffle partition, at least.
SPREAD = 4
_LAST_ID = (1 << 63) - 1
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lengthened(value: np.ndarray, by: int, factor: np.uint64 = _ONE) -> np.ndarray:
    """Hashes of sequences made of two that start ``by`` words apart, from those of the parts."""
    out = value.copy()
    if by < len(value):
        out[:-by] = mix(value[:-by] * factor + value[by:])
    return out


def sequences(value: np.ndarray, length: int, factor: np.uint64 = _ONE) -> np.ndarray:
    """Hash of the ``length`` words at each place, by doubling; those near the end aren't whole."""
    n = 1
    while n < length:
        by = min(n, length - n)
        value, n = lengthened(value, by, factor), n + by
    return value


class Chunk:
    """Words, windows, seeds and runs of the texts of a chunk."""

    def __init__(self, rows: pa.Table, window: int):
        self.window, half = window, -(-window // 2)
        self.rows = rows.sort_by("doc").combine_chunks()
        column = self.rows.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.data, at = raw(column)
        self.start, self.end, self.first = word_places(self.data, at, SPACED)
        self.doc = self.rows.column("doc").to_numpy()
        words = word_hashes(self.data, self.start, self.end)
        count = np.diff(self.first)
        row = np.repeat(np.arange(len(count)), count)
        #: The words at which windows start, and each one's document.
        self.at = np.flatnonzero(np.arange(len(words)) + window <= self.first[1:][row])
        self.of = self.doc[row[self.at]]
        seeds = sequences(words, half)
        width, span = window - half + 1, 1
        low = np.uint64(0xFFFFFF)
        least = (seeds & ~low) | (np.arange(len(seeds), dtype=np.uint64) & low)
        while span < width:
            by = min(span, width - span)
            least[:-by] = np.minimum(least[:-by], least[by:])
            span += by
        # a place is cut to 24 bits, which tell places of one window apart
        place = self.at + (((least[self.at] & low) - (self.at.astype(np.uint64) & low)) & low).astype(np.int64)
        self.seed = seeds[place]
        self.key = (lengthened(seeds, window - half) if window > half else seeds)[self.at]
        self.offset = place - self.at
        self.words = words
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (row[self.at][1:] != row[self.at][:-1])
        #: The first window of each run, and the run of each window.
        self.head = np.flatnonzero(new)
        self.run_of = np.cumsum(new) - 1

    def runs(self) -> np.ndarray:
        """Hash of each run: its windows, each with its distance to the seed."""
        if not len(self.head):
            return np.zeros(0, np.uint64)
        return mix(np.add.reduceat(mix(self.key + self.offset.astype(np.uint64) * _TWO), self.head))

    def also(self) -> np.ndarray:
        """A second hash of each window."""
        return (sequences(self.words, self.window, _TWO)[self.at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each key (of its least document), whether it has several documents, and the key's number at each place; doc ascends."""
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    last = np.zeros(len(one), dtype=np.int64)
    np.maximum.at(last, of, doc)
    return one, last > doc[one], of


def _has(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key is among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(key), dtype=bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _told(found: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a kind that were sent to a chunk, sorted, and their second hashes."""
    own = found.column("kind").to_numpy() == kind
    key = found.column("key").to_numpy().astype(np.int64)[own].view(np.uint64)
    order = np.argsort(key)
    return key[order], found.column("also").to_numpy()[own][order]


def _number(rows: pa.Table, n: int) -> pa.Array:
    return pa.array(np.full(n, rows.column("chunk")[0].as_py() if rows.num_rows else 0, dtype=np.int64))


SEED, RUN, CUT, WHOLE = 0, 1, 2, 3


def covered(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed ranges of words of each row."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = texts(docs)
    total = own.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = max(SPREAD * partitions, -(-total // chunk_bytes))
    # equal rows of one split meet in a chunk; those of different splits are dealt apart
    number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks))
    dealt = own.select(number.alias("chunk"), "doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("doc"), "text").repartition(partitions, "chunk")

    def seeds(rows: pa.Table) -> pa.Table:
        x = Chunk(rows, window)
        one, several, _ = _least(x.seed[x.head], x.of[x.head])
        return pa.table({"chunk": _number(rows, len(one)), "key": _signed(x.seed[x.head][one]), "several": pa.array(several)})

    def runs(rows: pa.Table, found: pa.Table) -> pa.Table:
        x = Chunk(rows, window)
        ask = np.flatnonzero(_has(_told(found, SEED)[0], x.seed[x.head]))
        seed, run, doc = x.seed[x.head][ask], x.runs()[ask], x.of[x.head][ask]
        one, *_ = _least(mix(seed + run * _TWO), doc)
        return pa.table({"chunk": _number(rows, len(one)), "seed": _signed(seed[one]), "key": _signed(run[one]), "doc": pa.array(doc[one])})

    def windows(rows: pa.Table, found: pa.Table) -> pa.Table:
        x = Chunk(rows, window)
        open_ = _has(_told(found, CUT)[0], mix(x.seed[x.head] + x.runs() * _TWO))[x.run_of] if len(x.at) else np.zeros(0, bool)
        key, doc, also = x.key[open_], x.of[open_], x.also()[open_]
        one, *_ = _least(key, doc)
        return pa.table({"chunk": _number(rows, len(one)), "key": _signed(key[one]), "also": pa.array(also[one]), "doc": pa.array(doc[one])})

    def result(rows: pa.Table, found: pa.Table) -> pa.Table:
        x = Chunk(rows, window)
        gone = np.zeros(len(x.start) + 1, dtype=np.int64)
        if len(x.at):
            one, _, of = _least(x.key, x.of)
            hit = x.of > x.of[one][of]
            hit |= _has(_told(found, RUN)[0], mix(x.seed[x.head] + x.runs() * _TWO))[x.run_of]
            key, also = _told(found, WHOLE)
            if len(key):
                at = np.minimum(np.searchsorted(key, x.key), len(key) - 1)
                hit |= (key[at] == x.key) & (also[at] == x.also())
            gone[x.at[hit]] += 1
            gone[x.at[hit] + window] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        return _kept(x, gone)

    def asked(level: DataFrame, kind: int) -> DataFrame:
        return level.select("chunk", F.lit(kind).alias("kind"), "key", F.lit(0).alias("also"))

    by_chunk = dealt.groupBy("chunk")
    by_key = Window.partitionBy("key")
    level = by_chunk.applyInArrow(seeds, "chunk bigint, key bigint, several boolean")
    level = level.withColumn("repeated", F.max("several").over(by_key) | (F.min("chunk").over(by_key) < F.max("chunk").over(by_key)))
    found = asked(level.filter("repeated"), SEED)

    level = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(runs, "chunk bigint, seed bigint, key bigint, doc bigint")
    by_seed, by_run = Window.partitionBy("seed"), Window.partitionBy("seed", "key")
    level = level.withColumns({"least": F.min("doc").over(by_run), "differ": F.min("key").over(by_seed) < F.max("key").over(by_seed)})
    level = level.withColumn("kind", F.when(F.col("least") < F.col("doc"), RUN).when(F.col("differ"), CUT)).filter("kind is not null")
    # a run is told by one hash of its seed and itself, as the chunk makes it again
    decided = level.select("chunk", "kind", "seed", "key").mapInArrow(_joined, "chunk bigint, kind int, key bigint, also int")

    level = by_chunk.cogroup(decided.filter(F.col("kind") == CUT).groupBy("chunk")).applyInArrow(windows, "chunk bigint, key bigint, also int, doc bigint")
    level = level.withColumn("least", F.min("doc").over(Window.partitionBy("key", "also"))).filter("least < doc")
    found = decided.filter(F.col("kind") == RUN).union(level.select("chunk", F.lit(WHOLE).alias("kind"), "key", "also"))
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(result, _OUT)


def _joined(batches):
    for batch in batches:
        seed, run = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(mix(seed + run * _TWO)), pa.array(np.zeros(len(seed), np.int32))], names=["chunk", "kind", "key", "also"])


_OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _kept(x: Chunk, gone: np.ndarray) -> pa.Table:
    """Rows of the result: the words left are joined by one space."""
    row = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
    n_removed = np.bincount(row[gone], minlength=len(x.first) - 1).astype(np.int64)
    kept = np.flatnonzero(~gone)
    edge = np.zeros(len(x.data) + 1, dtype=np.int8)
    np.add.at(edge, x.start[kept], 1)
    np.add.at(edge, x.end[kept], -1)
    left = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = x.data.copy()
    between = x.start[kept[1:][row[kept[1:]] == row[kept[:-1]]]] - 1
    out[between], left[between] = 32, True
    out, size = out[left], np.zeros(len(x.first) - 1, dtype=np.int64)
    np.add.at(size, row[kept], x.end[kept] - x.start[kept])
    joins = np.bincount(row[kept], minlength=len(size))
    ends = np.cumsum(size + np.maximum(joins - 1, 0))
    digests = [hashlib.sha256(out[a:b].tobytes()).hexdigest() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    # ranges of removed words, counted within their text
    flag = np.concatenate([[0], gone.astype(np.int8), [0]])
    fresh = np.zeros(len(gone) + 1, dtype=bool)
    fresh[x.first] = True
    starts = np.flatnonzero(gone & ((flag[:-2] == 0) | fresh[:-1]))
    stops = np.flatnonzero(gone & ((flag[2:] == 0) | fresh[1:])) + 1
    begin = x.first[row[starts]]
    counts = np.bincount(row[starts], minlength=len(size))
    spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays([pa.array(starts - begin), pa.array(stops - begin)], names=["start", "end"]))
    return pa.table({"doc_id": x.rows.column("doc_id"), "n_words": pa.array(np.diff(x.first)), "n_removed": pa.array(n_removed), "kept_sha256": pa.array(digests, pa.string()), "spans": spans.cast(_SPANS)})


def op13_phrase_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, windows of 13 words."""
    return covered(table(spark, folder, "documents")).drop("spans")


#: The same by DuckDB: all windows as texts, the least document of each.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
least AS (SELECT s, min(id) AS first FROM win GROUP BY s),
hit AS (SELECT DISTINCT r, i + k AS i FROM win JOIN least USING (s), unnest(range(13)) AS t(k) WHERE first < id),
lost AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
word AS (SELECT r, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
