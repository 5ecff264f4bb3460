"""Benchmark decontamination by an FM-index for each shard of the training texts.

A shard is a chunk of rows inside a task. Its words become symbols of the benchmark's vocabulary; a stretch of words shorter
than the shortest window, or with a word the benchmark lacks, can hold no window and is left out. Over the stretches left stands an FM-index: suffix order, its
Burrows-Wheeler transform in a wavelet matrix, and positions sampled every few words and at each stretch's start.
All windows are searched backwards side by side; their rows are walked to a sampled position, and the spans found
are merged into hit words.

The benchmark is the stated query set. It is searched in blocks of at most BLOCK_BYTES of text (or one item), each broadcast by itself, so
what is broadcast is bounded whatever the benchmark's size; each block is one pass over the texts, written to the shared folder before the
next block is sent. Texts aren't shuffled, and a lost task is run again from its input. Words are compared by 64-bit hashes.

Null texts have no words. Items without words are in no result; repeated ids count once, a null id as an empty
text. An empty benchmark hits nothing. Repeated documents repeat their result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm import common
from csilake.llm.common import PLAIN, chunks, stored, table, texts, words

WINDOW = 13
BLOCK_BYTES = 4 << 20
SAMPLE = 8


class WaveletMatrix:
    """Counts of a symbol before a position, for many (symbol, position) at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (symbols >> bit & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, dtype=np.int64)
            np.cumsum(one, out=ones[1:])
            self.levels.append((bit, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = np.zeros(len(at), dtype=np.int64)
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return at - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling. Symbol 0 ends a stretch; each of its places counts as a symbol of its own."""
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()))
    n, step = len(symbols), 1
    while True:
        order = np.argsort(rank, kind="stable")
        sorted_rank = rank[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        far = np.zeros(n, dtype=np.int64)
        far[:-step] = rank[step:] + 1
        rank, step = rank * (n + 1) + far, 2 * step


class FmIndex:
    """Of a text of symbols above 0, whose stretches end with 0 each."""

    def __init__(self, symbols: np.ndarray, top: int):
        order = suffix_order(symbols)
        self.last = symbols[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.tree = WaveletMatrix(self.last, top)
        self.sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.position = order[self.sampled]
        self.index = np.cumsum(self.sampled) - 1

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows of equal length) that occur: their numbers and row ranges."""
        found = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.last))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[found, j]
            low, high = self.step(symbol, low), self.step(symbol, high)
            some = low < high
            found, low, high = found[some], low[some], high[some]
        return found, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walks to the left until a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        open_, at, walked = np.arange(len(rows)), rows, 0
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.position[self.index[at[done]]] + walked
            open_, at = open_[~done], at[~done]
            at, walked = self.step(self.last[at], at), walked + 1
        return out


@dataclass
class Windows:
    """A block of the benchmark: sorted word hashes (symbol k is the k-th, from 1), and windows by length with their items."""

    vocabulary: np.ndarray
    patterns: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Windows:
        *_, hashes, first = words(pa.array([text for _, text in rows], pa.string()), PLAIN)
        vocabulary, symbol = np.unique(hashes, return_inverse=True)
        common._CACHE.clear()  # else it would travel with the functions
        owners: dict[tuple[int, ...], set[str]] = {}
        for (item, _), a, b in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = (symbol[a:b] + 1).tolist()
            for i in range(max(1, len(own) - WINDOW + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + WINDOW]), set()).add(item)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for window in owners:
            by_length.setdefault(len(window), []).append(window)
        return cls(
            vocabulary,
            {n: np.array(x, dtype=np.int64) for n, x in by_length.items()},
            {n: [sorted(owners[w]) for w in x] for n, x in by_length.items()},
        )

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Of each text: where its words begin (one end more), a flag for each word, and the items found."""
        *_, hashes, first = words(column, PLAIN)
        n, hit, items = len(hashes), np.zeros(len(hashes), dtype=bool), [set() for _ in range(len(column))]
        if not self.patterns or not n:
            return first, hit, items
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == hashes, at + 1, 0)

        # Stretches of known words inside one text, long enough for a window.
        text_of = np.repeat(np.arange(len(column)), np.diff(first))
        known = np.flatnonzero(symbol)
        if not len(known):
            return first, hit, items
        cut = (np.diff(known) != 1) | (np.diff(text_of[known]) != 0)
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        sizes = np.diff(np.concatenate([starts, [len(known)]]))
        long = sizes >= min(self.patterns)
        kept = known[np.repeat(long, sizes)]
        if not len(kept):
            return first, hit, items
        ends = np.cumsum(sizes[long])
        line = np.insert(symbol[kept], ends, 0)
        word = np.insert(kept, ends, -1)

        index = FmIndex(line, len(self.vocabulary))
        edge = np.zeros(n + 1, dtype=np.int64)
        for length, patterns in self.patterns.items():
            found, low, high = index.search(patterns)
            many = high - low
            rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            place = word[index.locate(rows)]
            np.add.at(edge, place, 1)
            np.add.at(edge, place + length, -1)
            pairs = np.unique(text_of[place] * len(patterns) + np.repeat(found, many))
            for text, window in zip((pairs // len(patterns)).tolist(), (pairs % len(patterns)).tolist(), strict=True):
                items[text].update(self.items[length][window])
        return first, np.cumsum(edge[:-1]) > 0, items


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Columns under way; named so that they clash with none of the rows' own.
_WORDS, _SPANS, _ITEMS = "_decontaminate_words", "_decontaminate_spans", "_decontaminate_items"


def _merged(flags: np.ndarray, spans: list[dict]) -> list[dict]:
    """Maximal runs of hit words, with the spans that earlier blocks found."""
    for x in spans:
        flags[x["start"] : x["end"]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            filled = batch.set_column(at, "text", pc.fill_null(batch.column(at), ""))
            for a, b in chunks(filled, "text"):
                part = batch.slice(a, b - a)
                first, flags, items = windows.hits(filled.column(at).slice(a, b - a))
                old_spans, old_items = part.column(_SPANS).to_pylist(), part.column(_ITEMS).to_pylist()
                spans = [_merged(flags[first[i] : first[i + 1]], old_spans[i]) for i in range(len(items))]
                names = [sorted(new.union(old)) for new, old in zip(items, old_items, strict=True)]
                new = {_WORDS: pa.array(np.diff(first)), _SPANS: pa.array(spans, _SPAN), _ITEMS: pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(x, part.column(x)) for x in part.schema.names], names=part.schema.names)

    return run


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items, in lists of at most about BLOCK_BYTES of text each, one list on the driver at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if size <= BLOCK_BYTES else 2 * size // BLOCK_BYTES + 1
    for k in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(x.item, x.text) for x in own.toLocalIterator()]


def searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with the number of words, the runs of hit words and the items' ids (sorted strings) as columns _WORDS, _SPANS and _ITEMS."""
    context = docs.sparkSession.sparkContext
    kinds = {_WORDS: "bigint", _SPANS: "array<struct<start:bigint,end:bigint>>", _ITEMS: "array<string>"}
    start = {_WORDS: F.lit(0), _SPANS: F.array(), _ITEMS: F.array()}
    now = docs.withColumns({x: start[x].cast(kinds[x]) for x in kinds})
    shared = None
    for block in blocks(benchmark):
        if shared is not None:  # a block is done before the next one is sent
            now = stored(now, "decontaminate-block")
            shared.destroy()
        shared = context.broadcast(Windows.of(block))
        now = now.mapInArrow(_search(shared), now.schema)
    return now


def hit_words() -> Column:
    return F.aggregate(_SPANS, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def contaminated() -> Column:
    return (hit_words() > 0) & (20 * hit_words() >= F.col(_WORDS))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, ``spans`` (runs of hit words), ``items`` (ids, as sorted strings), contaminated."""
    found = searched(texts(docs), benchmark)
    return found.select("doc_id", F.col(_WORDS).alias("n_words"), hit_words().alias("n_hit"), F.col(_SPANS).alias("spans"), F.col(_ITEMS).alias("items"), contaminated().alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    return searched(docs, benchmark).filter(~contaminated()).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


#: The same by DuckDB: all windows of the items as texts, looked for among the documents' word sequences of the same lengths.
OP8_SQL = r"""
WITH cut AS (SELECT lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS word FROM (SELECT 'abcdefghijklmnopqrstuvwxyz' AS lower_az)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper(lower_az), lower_az), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, cut),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), upper(lower_az), lower_az), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, cut),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM win),
seq AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS MATERIALIZED (SELECT r, i, n, item_id FROM seq JOIN win USING (n, s)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
