"""Near duplicates by a Hamming join of MinHash signatures, confirmed on the full shingle sets.

A signature has SLOTS minima of SLOT_BITS bits. It is cut into CHUNKS chunks of WIDTH slots; two signatures that differ in
fewer than 2 * CHUNKS slots agree in some chunk up to one slot (pigeonhole), so each chunk is entered once for each of its slots
with that slot left out: all pairs at a distance up to MOST_ERRORS meet under a key. Pairs of similarity 0.8 differ
in a fifth of the slots on average and miss all keys with a chance below 1e-9; mates at a larger distance
aren't dropped. All links are confirmed on the sets, by 64-bit hashes of shingles.

No bucket is expanded into its pairs. Rows of equal sets become one class first. Each bucket's best connected member (the one
whose buckets hold most rows) is its hub; a hub and all mates from its buckets are a star, of one row for each mate. Hubs are
compared with their mates first, which joins most of a group of copies. Two mates of a bucket are in one star, so what is left is to
compare, in each star, the members outside its largest component with members of other components: links inside a
component aren't needed. Members are dealt over home blocks of BLOCK shingles and the outsiders over guest blocks of as many, and each
pair of a guest block and a home block is a cell. So no task holds a whole star or all its outsiders; a cell indexes the shingles of its home rows,
lets its guests pass and gives back confirmed links alone, one for each outsider and component. A star mostly of outsiders has
cells that grow with the square of its blocks.

Components are found by repeated minima over links, with a table written each round; nothing is collected. A null text or
one without words has no set, is linked with nothing and kept; its component is its own id. Each row goes by its own text: rows of
one id share a result if their sets are equal. A row without an id is found by its set alone: it belongs to the component of rows of equal
sets, and is kept if no row with an id has that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.common import SPACED, chunks, mix, raw, stored, table, texts, unused, words

CHUNKS, WIDTH = 16, 5
SLOTS = CHUNKS * WIDTH
SLOT_BITS = 16
MOST_ERRORS = 2 * CHUNKS - 1
#: Shingles of a star's members that one task holds.
BLOCK = 1 << 21
#: Comparisons of an outsider with a shingle of its star, above which members look for each other by prefixes first. So many took
#: a task three seconds; below, shuffling prefixes costs more than it saves.
APART = 1 << 30
SLOTS_OF_COUNTS = 1 << 18
#: Members with one shingle in their prefixes that one task compares.
POSTINGS = 1 << 14
#: Members compared with one hub in one task.
HUB_BLOCK = 512

_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 2-word shingles of each text as sorted hashes, and where each text's begin (one end more)."""
    *_, hashes, first = words(column, SPACED)
    count = np.diff(first)
    text = np.repeat(np.arange(len(column)), count)
    pair = text[1:] == text[:-1] if len(text) else np.zeros(0, dtype=bool)
    value = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[pair] if len(text) else hashes
    owner = text[1:][pair] if len(text) else text
    alone = np.flatnonzero(count == 1)
    value, owner = np.concatenate([value, hashes[first[alone]]]), np.concatenate([owner, alone])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(column) + 1))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SLOTS minima of each set, as 16-bit numbers; rows of empty sets are 0."""
    out = np.zeros((len(first) - 1, SLOTS), dtype=np.uint16)
    some = np.flatnonzero(np.diff(first))
    for k, seed in enumerate(_SEEDS if len(some) else ()):
        low = np.minimum.reduceat((value ^ seed) * seed >> np.uint64(16), first[some])
        out[some, k] = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def set_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set: equal sets, equal number."""
    one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (value, mix(value ^ _SEEDS[0])))
    a, b = (x[first[1:]] - x[first[:-1]] for x in (one, two))
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b) + np.diff(first).astype(np.uint64)).view(np.int64)


_FEATURES = "doc_id bigint, n_shingles bigint, id bigint, signature binary, text_key bigint"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text"):
            part = batch.slice(a, b - a)
            value, first = shingles(part.column(1))
            sign = signatures(value, first)
            held = pa.array([x.tobytes() for x in sign], pa.binary())
            columns = [part.column(0), pa.array(np.diff(first)), pa.array(set_ids(value, first)), held, part.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "id", "signature", "text_key"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1_000):
            part = batch.slice(at, 1_000)
            slots = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            keys = []
            for out in range(WIDTH):
                key = np.broadcast_to(mix(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(out + 1)), slots.shape[:2])
                for k in range(WIDTH):
                    if k != out:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, :, k])
                keys.append(key)
            found = np.stack(keys, axis=2).reshape(len(slots), -1)
            ids = np.repeat(part.column(0).to_numpy(), found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text"):
            part = batch.slice(a, b - a)
            value, first = shingles(part.column(1))
            held = pa.array([value[first[i] : first[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(value, first)), held, pa.array(np.diff(first))], names=["id", "shingles", "size"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked. A hub's members are dealt over blocks, each with one copy of the hub's set."""
    placed = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_BLOCK).alias("n"))
    placed = placed.join(sizes, "a").withColumn("block", F.col("block") % F.col("n"))
    sets = sets.select("id", "shingles")
    members = placed.join(sets, placed.b == sets.id).select("a", "block", F.col("b").alias("id"), "shingles")
    hubs = placed.select("a", "block").distinct().join(sets, F.col("a") == sets.id).select("a", "block", F.lit(None).cast("long").alias("id"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = hub = None
        for batch in batches:
            out = []
            for a, block, b, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = np.frombuffer(held, dtype=np.uint64)
                if b is None:
                    group, hub = (a, block), found
                elif group == (a, block) and linked(hub, found):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    # the hub's row comes first in its group: its id is null
    both = hubs.unionAll(members).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("id"))
    return both.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of all ids in links (a, b)."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component"))
    while True:
        # the least component of a row and its neighbours, which its component's other rows then learn too
        near = edges.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = now.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        roots = step.groupBy("component").agg(F.min("low").alias("up"))
        low = F.least("low", "up")
        now = stored(step.join(roots, "component").select("id", low.alias("component"), (low != F.col("component")).alias("changed")), "components")
        if not now.filter("changed").limit(1).count():
            return now.select("id", "component")
        now = now.drop("changed")


def _outsiders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell (a, gb, hb), home rows first: links of its guests with its home rows of other components. Home rows alone are held."""

    class Home:
        def __init__(self, rows: list):
            self.ids, self.component = (np.array([x[i] for x in rows], dtype=np.int64) for i in (0, 1))
            sets = [np.frombuffer(x[4], dtype=np.uint64) for x in rows]
            self.size = np.array([len(x) for x in sets])
            value, member = np.concatenate(sets), np.repeat(np.arange(len(rows)), self.size)
            order = np.argsort(value)
            self.value, self.member = value[order], member[order]

        def links(self, guest: int, kind: int, held: bytes) -> list[tuple[int, int]]:
            mine = np.frombuffer(held, dtype=np.uint64)
            low, high = np.searchsorted(self.value, mine), np.searchsorted(self.value, mine, side="right")
            many = high - low
            places = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(self.member[places], minlength=len(self.ids))
            near = np.flatnonzero((100 * both >= 80 * (self.size + len(mine) - both)) & (self.component != kind))
            one = near[np.unique(self.component[near], return_index=True)[1]]
            return [(guest, x) for x in self.ids[one].tolist()]

    def ready(rows: list) -> tuple[Home | None, list[tuple[int, int]]]:
        """The index of the home rows, and the links of those that are guests too."""
        if not rows:
            return None, []
        home = Home(rows)
        return home, [x for row in rows if row[2] for x in home.links(row[0], row[1], row[4])]

    def out(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    group, rows, home, opened = None, [], None, False
    for batch in batches:
        found: list[tuple[int, int]] = []
        for a, gb, hb, *row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if (a, gb, hb) != group:
                if not opened:
                    found.extend(ready(rows)[1])
                group, rows, home, opened = (a, gb, hb), [], None, False
            if row[3]:
                rows.append(row)
                continue
            if not opened:
                home, more = ready(rows)
                found.extend(more)
                rows, opened = [], True
            if home is not None:
                found.extend(home.links(row[0], row[1], row[4]))
        yield from out(found)
    if not opened:
        yield from out(ready(rows)[1])


def _in_star(star: np.ndarray, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all sets, each mixed with its star, and the sets' sizes."""
    value, at = raw(held)
    size = np.diff(at) // 8
    return mix(value.view(np.uint64) ^ np.repeat(mix(star.view(np.uint64)), size)), size


def _slots(value: np.ndarray) -> np.ndarray:
    return (value % np.uint64(SLOTS_OF_COUNTS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS_OF_COUNTS, dtype=np.int64)
    for batch in batches:
        for a, b in chunks(batch, "shingles"):
            part = batch.slice(a, b - a)
            total += np.bincount(_slots(_in_star(part.column("a").to_numpy(), part.column("shingles"))[0]), minlength=SLOTS_OF_COUNTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])


def postings(rows: DataFrame) -> DataFrame:
    """One row for each member (a, node, component, crowd, shingles) and shingle of its prefix, rarest first.

    Sets of m <= n shingles are linked if they share at least 4 (m + n) / 9. That is 8 m / 9 or more and 4 n / 5 or more, so their first
    common shingle has a place up to m // 9 in the smaller set (``home``) and up to n // 5 in the larger.
    """
    slots = rows.select("a", "shingles").mapInArrow(_slot_counts, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS_OF_COUNTS, dtype=np.int64)
    for slot, n in slots.collect():  # SLOTS_OF_COUNTS rows at most
        counts[slot] = n
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for a, b in chunks(batch, "shingles"):
                part = batch.slice(a, b - a)
                value, size = _in_star(part.column("a").to_numpy(), part.column("shingles"))
                owner = np.repeat(np.arange(len(size)), size)
                value = value[np.lexsort((value, often[_slots(value)], owner))]
                place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
                taken = np.flatnonzero(place <= size[owner] // 5)
                owner, place = owner[taken], place[taken]
                node, component, crowd = (part.column(x).to_numpy()[owner] for x in ("node", "component", "crowd"))
                columns = [value[taken].view(np.int64), node, size[owner], place, component, crowd, place <= size[owner] // 9]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "node", "size", "place", "component", "crowd", "home"])

    return rows.mapInArrow(run, "key bigint, node bigint, size bigint, place bigint, component bigint, crowd bigint, home boolean")


def _met(node: np.ndarray, size: np.ndarray, place: np.ndarray, component: np.ndarray, home: np.ndarray, guest: np.ndarray) -> np.ndarray:
    """Which rows of a cell may be linked with another one: of two, the smaller set is at home and the larger its guest."""
    met = np.zeros(len(node), dtype=bool)
    h, g = np.flatnonzero(home), np.flatnonzero(guest)
    h, g = h[np.argsort(size[h], kind="stable")], g[np.argsort(size[g], kind="stable")]
    for i in range(0, len(h), 256):
        some = h[i : i + 256]
        mates = g[np.searchsorted(size[g], size[some[0]]) : np.searchsorted(4 * size[g], 5 * size[some[-1]], side="right")]
        m, n = size[some][:, None], size[mates][None, :]
        room = np.minimum(m - place[some][:, None], n - place[mates][None, :])
        near = (9 * room >= 4 * (m + n)) & (4 * n <= 5 * m) & (component[some][:, None] != component[mates][None, :])
        near &= (m < n) | ((m == n) & (node[some][:, None] < node[mates][None, :]))
        met[some] |= near.any(axis=1)
        met[mates] |= near.any(axis=0)
    return met


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell (key, hb, gb), the members that may be linked with another one there, as links with the first of them."""

    def links(rows: list[np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
        start, end = bounds[:-1], bounds[1:]
        found = [np.zeros((0, 2), dtype=np.int64)]
        if len(start):
            kind = rows[6][: end[-1]]
            for i in np.flatnonzero(np.minimum.reduceat(kind, start) != np.maximum.reduceat(kind, start)).tolist():
                node, *rest = (x[start[i] : end[i]] for x in rows[3:])
                ids = np.unique(node[_met(node, *rest)])
                found.append(np.stack([np.full(max(len(ids) - 1, 0), ids[0] if len(ids) else 0), ids[1:]], axis=1))
        both = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    left: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        rows = rows if left is None else [np.concatenate(x) for x in zip(left, rows, strict=True)]
        fresh = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
        bounds = np.concatenate([[0], np.flatnonzero(fresh) + 1])
        yield links(rows, bounds)
        left = [x[bounds[-1] :] for x in rows]
    if left is not None:
        yield links(left, np.array([0, len(left[0])]))


def meetings(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups (a, id, size, component) of members of one star that may be linked, over chains of such pairs."""
    rows = rows.withColumn("node", F.xxhash64("a", "id"))
    found = stored(postings(rows.join(sets.select("id", "shingles"), "id").select("a", "node", "component", "crowd", "shingles")), "postings")
    hot = found.filter(F.col("crowd") > POSTINGS).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > POSTINGS)
    placed = found.join(hot, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / POSTINGS), F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cell = lambda hb, gb, home, guest: F.struct(hb.alias("hb"), gb.alias("gb"), home.alias("at_home"), guest.alias("guest"))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    at_home = F.transform(blocks, lambda x: cell(own, x, F.col("home"), F.lit(False)))
    as_guest = F.transform(blocks, lambda x: cell(x, own, F.lit(False), F.lit(True)))
    cells = F.when(F.col("blocks") == 1, F.array(cell(own, own, F.col("home"), F.lit(True)))).otherwise(F.concat(at_home, as_guest))
    placed = placed.select("*", F.inline(cells)).filter("at_home or guest")
    placed = placed.select("key", "hb", "gb", "node", "size", "place", "component", "at_home", "guest")
    edges = placed.repartition("key", "hb", "gb").sortWithinPartitions("key", "hb", "gb").mapInArrow(_meetings, "a bigint, b bigint")
    group = components(edges).select(F.col("id").alias("node"), F.col("component").alias("group"))
    return rows.join(group, "node").select(F.col("group").alias("a"), "id", "size", "component")


def _parts(label: DataFrame) -> DataFrame:
    """Of each a with members of several components: their number and shingles, and those of its largest component."""
    each = label.groupBy("a", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = each.groupBy("a").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "component", "size")).alias("top"))
    return parts.filter("parts > 1")


def outsiders(stars: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of one star (hub a, mate b) that are in different components so far."""
    members = stars.select("a", F.col("b").alias("id")).union(stars.select("a", F.col("a").alias("id")).distinct())
    label = members.join(found, "id", "left").join(sets.select("id", "size"), "id").select("a", "id", "size", F.coalesce("component", "id").alias("component"))
    # a star of two is its hub and one mate, which have been compared
    apart = (F.col("n") - F.col("top.n")) * F.col("size") > APART
    label = stored(label.join(_parts(label).filter("n > 2").select("a", F.col("n").alias("crowd"), apart.alias("apart")), "a"), "members")
    groups = label.filter(~F.col("apart")).select("a", "id", "size", "component")
    if label.filter("apart").limit(1).count():
        groups = groups.union(meetings(label.filter("apart"), sets))

    count = lambda size: F.ceil(size / BLOCK)
    open_ = _parts(groups).select("a", count(F.col("size")).alias("homes"), count(F.col("size") - F.col("top.size")).alias("guests"), F.col("top.component").alias("top"))
    deal = F.xxhash64("id")
    rows = groups.join(open_, "a").withColumns({"own_gb": F.pmod(deal, F.col("guests")), "own_hb": F.pmod(F.xxhash64(deal), F.col("homes")), "outside": F.col("component") != F.col("top")})
    cell = lambda gb, hb: F.struct(gb.alias("gb"), hb.alias("hb"))
    range_ = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at_home = F.transform(range_("guests"), lambda x: cell(x, F.col("own_hb")))
    as_guest = F.transform(range_("homes"), lambda x: cell(F.col("own_gb"), x))
    placed = rows.withColumn("cell", F.explode(F.when(F.col("outside"), F.array_union(at_home, as_guest)).otherwise(at_home))).select("*", "cell.gb", "cell.hb")
    placed = placed.withColumns({"guest": F.col("outside") & (F.col("gb") == F.col("own_gb")), "home": F.col("hb") == F.col("own_hb")})
    ready = placed.join(sets.select("id", "shingles"), "id").select("a", "gb", "hb", "id", "component", "guest", "home", "shingles")
    return ready.repartition("a", "gb", "hb").sortWithinPartitions("a", "gb", "hb", F.desc("home")).mapInArrow(_outsiders, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row, with its ``set_id``, the ``text_key`` xxhash64(text) and its ``component``.

    component_id is the least doc_id of a component; two have the same one if an id stands on rows of unlinked texts. ``component``,
    the least set id, tells them apart; it is null for a row without a set.
    """
    docs = texts(docs)
    features = stored(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_features, _FEATURES), "signatures")
    classes = features.filter("n_shingles > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")
    signed = classes.select("id", "signature")

    keys = signed.mapInArrow(_keys, "key bigint, id bigint")
    buckets = stored(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "buckets")
    weighed = buckets.join(buckets.groupBy("id").agg(F.sum("n").alias("weight")), "id")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("top")).select("key", F.col("top.id").alias("a"))
    stars = stored(buckets.join(hubs, "key").filter("a != id").select("a", F.col("id").alias("b")).distinct(), "stars")

    # one text of each class that has a bucket mate
    wanted = classes.join(buckets.select("id").distinct(), "id", "left_semi").select("doc_id").distinct()
    some = docs.join(wanted, "doc_id").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"])
    sets = stored(some.select("doc_id", "text").mapInArrow(_sets, "id bigint, shingles binary, size bigint"), "sets")

    links = stored(confirmed(stars, sets), "links")
    whole = components(links.union(outsiders(stars, components(links), sets)))

    known = classes.join(whole, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = known.join(least, "component").select("id", "component", "component_id")
    features = features.drop("signature")
    out = features.filter("n_shingles > 0").join(by_set, "id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.withColumn("component", F.coalesce("component", "id"))
    out = out.unionByName(features.filter("n_shingles = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")}))
    out = out.select("doc_id", "n_shingles", "component_id", F.col("id").alias("set_id"), "text_key", "component")
    kept = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "set_id", "text_key", "component")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns; of rows that repeat its id, the least by text hash.

    Rows without a set are all kept, but those that repeat an id and its text, or without an id a whole row, are one.
    """
    doc, key, whole, chosen_doc, chosen_key = unused(docs, "_doc", "_text", "_row", "_id", "_key")
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), key: F.xxhash64(F.coalesce("text", F.lit("")))})
    some = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chosen = near_duplicates(docs).filter("kept and n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    chosen = chosen.select(F.col("row.doc_id").alias(chosen_doc), F.col("row.text_key").alias(chosen_key))
    same = F.col(doc).eqNullSafe(F.col(chosen_doc)) & (F.col(key) == F.col(chosen_key))
    first = keyed.filter(some).join(chosen, same, "left_semi").dropDuplicates([doc, key])
    row = F.when(F.col(doc).isNull(), F.to_json(F.struct(*docs.columns)))
    bare = keyed.filter(~some).withColumn(whole, row).dropDuplicates([doc, key, whole])
    return first.select(*docs.columns).unionAll(bare.select(*docs.columns))


def op5_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    """All documents; whether each is the least of its component."""
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: The same by DuckDB: every pair of texts that share a word pair, compared on the full sets.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d
), each AS MATERIALIZED (SELECT r, hash(x) AS x FROM sets, unnest(s) AS t(x)),
size AS MATERIALIZED (SELECT r, len(s) AS n FROM sets),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM each a JOIN each b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reach AS (SELECT r AS a, r AS b FROM size UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (r)
"""
