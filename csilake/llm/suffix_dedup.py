"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a LENGTH-byte string that also starts earlier in the corpus is removed; order is document id, then place. One transform of the
whole corpus can't be cut over machines, so the windows (all LENGTH-byte strings) are first dealt by content: a window's
anchor is its SEED-byte substring of least hash (the leftmost of equals), so equal windows have equal anchors at one offset. Windows in a row with one
anchor are a segment. Segments are shuffled as hashes by their anchor; of equal segments the first stays, and all bytes
of the others' windows go. A segment alone with its anchor repeats nowhere. Only segments that share an anchor and differ
need their texts.

These are cut, in place relative to the anchor, into pieces of at most STEP windows; what all windows of a piece have in common is its
core, and pieces meet by core. Pieces that still differ are dealt to two shards. Each shard has its own transform (two bytes a
step); the shards are merged by refining their interleave: each pass deals the rows stably by the bytes before them, and
after LENGTH / 2 passes the interleave is that of the merged suffix order, up to LENGTH bytes, without sorting the suffixes of both
again. The same passes tell which neighbours have had all bytes in common so far; those that no pass parts have a common prefix of
LENGTH bytes and form the repeated intervals, and all but an interval's first occurrence are removed.

An anchor with over HOT different segments (a passage in very many documents, each going on differently) is cut to single
windows, keyed by their own hashes and sorted by place; of each key the first row alone is held, so no group is gathered whole. Copies inside a chunk of a task are merged before any
shuffle. Equality of segments, pieces and single windows is by 64-bit hashes of the whole strings, that of merged windows by their bytes.

A null text is empty. Rows that repeat an id and text share one result; rows of one id and different texts are ordered by
text hash; null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.common import CHUNK_BYTES, _tables, chunks, mix, offsets, ranges_hash, raw, stored, table, texts

LENGTH, SEED, STEP = 100, 16, 8
HOT = 20_000
#: Bytes of one piece of a very long text; pieces overlap by LENGTH - 1.
PIECE = 8 << 20
#: Bytes of segments looked at together, and of differing pieces whose transforms are merged at once (few, so both stay in cache).
GROUP_BYTES, MERGE_BYTES = 1 << 20, 1 << 17
_LAST_ID = (1 << 63) - 1


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the SEED bytes at each place, and for each window the place of its least one."""
    value, step, factor = _tables(1)[2][data], 1, 0x9E3779B97F4A7C15
    while step < SEED:
        longer = value.copy()
        longer[:-step] = value[:-step] * np.uint64(factor) + value[step:]
        value, step, factor = longer, 2 * step, factor * factor % (1 << 64)
    value *= np.uint64(0xD6E8FEB86659FD93)  # carries low bits up, where the order looks
    place = np.uint64(0xFFFFFF)
    least = (value & ~place) | (np.arange(len(value), dtype=np.uint64) & place)
    width, span = LENGTH - SEED + 1, 1
    while span < width:
        far = min(span, width - span)
        least[:-far] = np.minimum(least[:-far], least[far:])
        span += far
    return value, (least & place).astype(np.int64)


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts from at[i] to at[i + 1]: first window, number of windows, offset of the anchor in it, anchor hash and segment hash."""
    value, anchor = anchors(data)
    ends = np.zeros(len(data) + 1, dtype=np.int8)
    long = np.diff(at) >= LENGTH
    ends[at[:-1][long]] += 1
    ends[at[1:][long] - LENGTH + 1] -= 1
    window = np.flatnonzero(np.cumsum(ends[:-1], dtype=np.int8))
    if not len(window):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    own = anchor[window]
    cut = np.ones(len(window), dtype=bool)
    cut[1:] = (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)
    cut[np.searchsorted(window, at[:-1][long])] = True
    start = window[cut]
    n = np.diff(np.append(np.flatnonzero(cut), len(window)))
    offset = own[cut] - start
    whole = ranges_hash(data, start, start + n + LENGTH - 1)
    return start, n, offset, value[own[cut]], mix(whole + offset.astype(np.uint64))


def firsts(group: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and order, and for each of them whether its place differs from that of the first row of its group."""
    row = np.lexsort((*order[::-1], group))
    sorted_group = group[row]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = sorted_group[1:] != sorted_group[:-1]
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    later = np.zeros(len(row), dtype=bool)
    for x in order:
        later |= x[row] != x[row][first]
    return row, later


#: kind 0: a segment; 1: windows to remove; 2: a segment that shares its anchor with others.
_ROW = "kind int, key bigint, hash bigint, doc bigint, text_key bigint, start bigint, n int, anchor int"
_NAMES = [x.split(" ")[0] for x in _ROW.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 5, *[pa.int32()] * 2]


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    values = [np.full(n, kind), *(x.view(np.int64) if x.dtype == np.uint64 else x for x in columns)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, _TYPES, strict=True)], names=_NAMES)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text", min(CHUNK_BYTES, PIECE)):
            part = batch.slice(a, b - a)
            whole, at = raw(part.column(2))
            doc, text_key = (part.column(i).to_numpy() for i in (0, 1))
            if len(whole) <= PIECE:
                pieces = [(whole, at, np.zeros(len(at) - 1, dtype=np.int64))]
            else:  # one long text
                pieces = [(whole[x : x + PIECE + LENGTH - 1], np.array([0, min(PIECE + LENGTH - 1, len(whole) - x)]), np.array([x])) for x in range(0, len(whole), PIECE)]
            for data, at, skipped in pieces:
                start, n, offset, key, value = segments(data, at)
                text = np.searchsorted(at, start, side="right") - 1
                place = start - at[text] + skipped[text]
                d, t = doc[text], text_key[text]
                row, later = firsts(value, d, t, place)
                kept, gone = row[~later], row[later]
                yield _rows(0, key[kept], value[kept], d[kept], t[kept], place[kept], n[kept], offset[kept])
                if len(gone):
                    gone = gone[np.lexsort((place[gone], t[gone], d[gone]))]
                    d, t, s, m = d[gone], t[gone], place[gone], n[gone]
                    new = np.ones(len(gone), dtype=bool)
                    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + m[:-1])
                    head = np.flatnonzero(new)
                    total = np.add.reduceat(m, head)
                    zero = np.zeros(len(head), dtype=np.int64)
                    yield _rows(1, mix(d[head].astype(np.uint64) ^ s[head].astype(np.uint64)), zero, d[head], t[head], s[head], total, zero)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, hash, doc, text_key, start: copies of a segment become kind 1, first ones of shared anchors kind 2."""
    held: list[pa.RecordBatch] = []
    before = first = None  # the last row's (key, hash) and the place of the first row of its group
    shared = False  # whether the group held back is known to share its anchor
    for batch in batches:
        column = [batch.column(i).to_numpy() for i in range(8)]
        done = column[0] == 1
        if done.any():
            yield batch.filter(pa.array(done))
        column = [x[~done] for x in column]
        n = len(column[0])
        if not n:
            continue
        _, key, value, doc, text, start, _, _ = column
        if before is None:
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            fresh = new_key | np.concatenate([[True], value[1:] != value[:-1]])
        else:
            new_key = np.concatenate([[key[0] != before[0]], key[1:] != key[:-1]])
            fresh = new_key | np.concatenate([[value[0] != before[1]], value[1:] != value[:-1]])
        number = np.cumsum(fresh) - 1
        heads = np.flatnonzero(fresh)
        first_of = [x[heads][np.maximum(number, 0)] if len(heads) else x for x in (doc, text, start)]
        if not fresh[0]:
            lead = number < 0
            first_of = [np.where(lead, first[i], x) for i, x in enumerate(first_of)]
        later = ~fresh & ((doc != first_of[0]) | (text != first_of[1]) | (start != first_of[2]))
        if later.any():
            yield _rows(1, *(x[later] for x in column[1:]))
        # of the first rows, those whose neighbour (before or after) has their key
        if len(heads):
            joins = ~new_key[heads]
            if held:
                if joins[0]:
                    yield _rows(2, *held[0])
                elif shared:
                    yield _rows(2, *held[0])
                held = []
            after = np.append(joins[1:], False)
            own = joins | after
            out = heads[:-1][own[:-1]]
            if len(out):
                yield _rows(2, *(x[out] for x in column[1:]))
            held, shared = [[x[heads[-1:]] for x in column[1:]]], bool(joins[-1])
        before = (key[-1], value[-1])
        first = tuple(x[-1] for x in first_of)
    if held and shared:
        yield _rows(2, *held[0])


_PIECE = "key bigint, doc bigint, text_key bigint, start bigint, n int, anchor int, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the wanted segments; of hot ones each window by itself, by its hash alone."""
    names = [x.split(" ")[0] for x in _PIECE.split(", ")]
    for batch in batches:
        doc, text_key, text, wanted = (batch.column(i) for i in range(4))
        out: list[tuple] = []
        for d, t, body, each in zip(doc.to_pylist(), text_key.to_pylist(), text.cast(pa.binary()).to_pylist(), wanted.to_pylist(), strict=True):
            for x in each:
                s, n = x["start"], x["n"]
                if x["hot"]:
                    data = np.frombuffer(body, dtype=np.uint8, count=n + LENGTH - 1, offset=s)
                    at = np.arange(n)
                    for i, h in enumerate(ranges_hash(data, at, at + LENGTH).view(np.int64).tolist()):
                        out.append((h, d, t, s + i, 1, 0, b""))
                else:
                    out.append((x["key"], d, t, s, n, x["anchor"], body[s : s + n + LENGTH - 1]))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _CUT_TYPES, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _CUT_TYPES, strict=True)], names=names)


_CUT_TYPES = [*[pa.int64()] * 4, *[pa.int32()] * 2, pa.binary()]


class Transform:
    """Burrows-Wheeler transform of a shard's strings, two bytes a step; strings end in 0xFF, which UTF-8 lacks."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"\xff".join(strings) + b"\xff", dtype=np.uint8)
        self.order = self._rotations()
        wide = self.text.astype(np.uint16)
        self.pairs = ((np.roll(wide, 2) << 8) | np.roll(wide, 1))[self.order]

    def _rotations(self) -> np.ndarray:
        n, step, rank = len(self.text), 1, self.text.astype(np.int64)
        while True:
            order = np.argsort(rank, kind="stable")
            ranked = rank[order]
            fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if fresh[-1] == n - 1 or step >= 2 * n:
                return order
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            rank, step = rank * n + np.roll(rank, -step), 2 * step


def interleave(one: Transform, two: Transform, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the merged order, up to ``depth`` bytes (an even number): whether it is of the second transform, and the number of its interval.

    Rows of one interval have their first ``depth`` bytes in common. A pass puts two bytes before what a row had: neighbours that
    it deals to one pair of bytes, out of one interval of the pass before, stay together, and all others part.
    """
    second = np.concatenate([np.zeros(len(one.text), dtype=bool), np.ones(len(two.text), dtype=bool)])
    interval, dealt = np.zeros(len(second), dtype=np.int32), None
    for _ in range(depth // 2):
        if dealt is None:  # the interleave has changed, so rows are dealt in a new way
            before = np.empty(len(second), dtype=np.uint16)
            before[~second], before[second] = one.pairs, two.pairs
            order = np.argsort(before, kind="stable")
            refined, pair = second[order], before[order]
            parts = pair[1:] != pair[:-1]
            if np.array_equal(refined, second):
                dealt = order
            second = refined
        held = interval[order]
        interval[0] = 0
        np.cumsum(parts | (held[1:] != held[:-1]), out=interval[1:])
    return second, interval


def repeated(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in merged suffix order: number of the string, place in it, and number of the interval of equal windows."""
    numbers = np.arange(len(strings))
    shards = [numbers[k::2] for k in (0, 1)]
    transforms = [Transform([strings[i] for i in x]) for x in shards]
    second, interval = interleave(*transforms)
    owner, place = (np.empty(len(second), dtype=np.int64) for _ in range(2))
    window = np.empty(len(second), dtype=bool)
    for mine, x, part in ((~second, transforms[0], shards[0]), (second, transforms[1], shards[1])):
        size = np.array([len(strings[i]) + 1 for i in part])
        begin = np.cumsum(size) - size
        text_of = np.repeat(np.arange(len(part)), size)
        at = np.arange(len(x.text)) - begin[text_of]
        inside = at <= size[text_of] - 1 - LENGTH
        owner[mine], place[mine], window[mine] = part[text_of][x.order], at[x.order], inside[x.order]
    return owner[window], place[window], interval[window]


class Pieces:
    """Gathers differing pieces until there are enough to merge."""

    def __init__(self):
        self.strings: list[bytes] = []
        self.where: list[tuple[int, int, int]] = []
        self.size = 0

    def take(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows of whole groups: key, doc, text_key, start, n, anchor, bytes."""
        if not rows:
            return
        key, doc, text, start, n, anchor = (np.array([x[i] for x in rows], dtype=np.int64) for i in range(6))
        size = np.array([len(x[6]) for x in rows])
        data = np.frombuffer(b"".join(x[6] for x in rows), dtype=np.uint8)
        begin = np.cumsum(size) - size
        shift = LENGTH - SEED  # a window starts at most so far before its anchor
        low = (shift - anchor) // STEP
        count = (shift - anchor + n - 1) // STEP - low + 1
        row = np.repeat(np.arange(len(rows)), count)
        block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
        head = block * STEP - shift + anchor[row]  # the block's first window, maybe before the segment
        a, b = np.maximum(head, 0), np.minimum(head + STEP, n[row])
        at = begin[row]
        core = ranges_hash(data, at + head + STEP - 1, at + head + LENGTH)
        group = mix(key[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + block.astype(np.uint64)) ^ core
        whole = ranges_hash(data, at + a, at + b + LENGTH - 1)
        value = mix(group + whole + (a - head).astype(np.uint64))
        d, t, s = doc[row], text[row], start[row] + a
        order, later = firsts(value, d, t, s)
        gone = order[later]
        yield from self.removed(d[gone], t[gone], s[gone], (b - a)[gone])
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = value[order][1:] != value[order][:-1]
        kept = order[fresh]
        kept = kept[np.argsort(group[kept], kind="stable")]
        same = group[kept][1:] == group[kept][:-1]
        differ = kept[np.append(same, False) | np.insert(same, 0, False)] if len(kept) else kept
        last = None
        for i, of in zip(differ.tolist(), group[differ].tolist(), strict=True):
            if self.size > MERGE_BYTES and of != last:
                yield from self.merge()
            last = of
            self.strings.append(data[at[i] + a[i] : at[i] + b[i] + LENGTH - 1].tobytes())
            self.where.append((d[i], t[i], s[i]))
            self.size += len(self.strings[-1])

    def merge(self) -> Iterator[pa.RecordBatch]:
        if len(self.strings) > 1:
            owner, place, interval = repeated(self.strings)
            where = np.array(self.where, dtype=np.int64)[owner]
            d, t, s = where[:, 0], where[:, 1], where[:, 2] + place
            order, later = firsts(interval, d, t, s)
            gone = order[later]
            yield from self.removed(d[gone], t[gone], s[gone], np.ones(len(gone), dtype=np.int64))
        self.__init__()

    @staticmethod
    def removed(doc: np.ndarray, text: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ranges of windows, those in a row as one."""
        if len(doc):
            order = np.lexsort((start, text, doc))
            doc, text, start, n = doc[order], text[order], start[order], n[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + n[:-1])
            head = np.flatnonzero(new)
            columns = [doc[head], text[head], start[head], np.add.reduceat(n, head)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (*[pa.int64()] * 3, pa.int32()), strict=True)], names=["doc", "text_key", "start", "n"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows, sorted by key and place, then segments sorted by key, of which groups (of HOT at most) are taken whole, many at once."""
    pieces, rows, size = Pieces(), [], 0
    before = first = None  # the last single window's key and the place of the first one of that key
    for batch in batches:
        alone = np.diff(offsets(batch.column(6))) == 0
        if alone.any():
            key, *place = (batch.column(i).to_numpy()[alone] for i in range(4))
            place = np.stack(place)
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            fresh[0] = before is None or key[0] != before
            least = np.concatenate([place[:, :1] if first is None else first, place[:, fresh]], axis=1)[:, np.cumsum(fresh)]
            later = (place != least).any(axis=0)
            before, first = key[-1], least[:, -1:]
            yield from pieces.removed(*place[:, later], np.ones(int(later.sum()), dtype=np.int64))
            batch = batch.filter(pa.array(~alone))
        for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if size > GROUP_BYTES and row[0] != rows[-1][0]:
                yield from pieces.take(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[6]) + 64
    yield from pieces.take(rows)
    yield from pieces.merge()


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            edge = np.zeros(len(text) + 1, dtype=np.int64)
            for x in ranges or ():
                edge[x["start"]] += 1
                edge[x["start"] + x["n"] + LENGTH - 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
            left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            out.append((doc, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        kinds = [*[pa.int64()] * 4, pa.string(), _SPANS]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=[x.split(" ")[0] for x in _OUT.split(", ")][:5] + ["spans"])


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges of each row."""
    docs = texts(docs).withColumns({"doc": F.coalesce("doc_id", F.lit(_LAST_ID)), "text_key": F.xxhash64("text")})
    dealt = docs.select("doc", "text_key", "text").mapInArrow(_segments, _ROW)
    sorted_ = dealt.repartition("key").sortWithinPartitions("key", "hash", "doc", "text_key", "start")
    found = stored(sorted_.mapInArrow(_matched, _ROW), "segments")

    shared = found.filter("kind = 2").select("key", "doc", "text_key", "start", "n", "anchor")
    many = shared.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > hot).select("key", F.lit(True).alias("hot"))
    flagged = shared.join(many, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = flagged.groupBy("doc", "text_key").agg(F.collect_list(F.struct("key", "start", "n", "anchor", "hot")).alias("wanted"))
    cut = docs.select("doc", "text_key", "text").join(wanted, ["doc", "text_key"]).mapInArrow(_cut, _PIECE)
    ordered = cut.repartition("key").sortWithinPartitions(F.length("bytes") > 0, "key", "doc", "text_key", "start")
    merged = ordered.mapInArrow(_merged, "doc bigint, text_key bigint, start bigint, n int")

    gone = found.filter("kind = 1").select("doc", "text_key", "start", "n").union(merged)
    by_text = gone.groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    return docs.join(by_text, ["doc", "text_key"], "left").select("doc_id", "text", "ranges").mapInArrow(_result, _OUT)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(table(spark, folder, "documents"))
