"""Byte-pair encoding and decoding by a segment tree over the ranks of adjacent pairs.

A word's symbols are the leaves' left ends: leaf i holds (rank of symbol i with its right neighbour, i), so the root of the
minimum tree is the leftmost pair of lowest rank. A merge changes three leaves (the pair's, its right one's, its
left neighbour's) and their paths to the root; the word is done when the root holds no pair. Words of like width
are merged side by side as rows of one array, long ones alone; results are kept per task in a bounded cache.

The vocabulary is a file with pre-tokeniser ``ByteLevel``, as a parameter. Its tables, of the file's size, are broadcast. Encoding a
row needs no other row: no shuffle, and a lost task is just run again. A null text is empty and has no ids. Special
tokens' strings in a text become their ids, as the library has it; decoding replaces bytes that are no UTF-8.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from csilake.llm.common import table, texts

# The pattern that splits a text before the merges, white space by its Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

CACHE_WORDS = 300_000
#: Symbols above which a word is merged alone.
WIDE = 64
_NONE = np.int64(1) << 62
_PLACE = 1 << 32


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a vocabulary file: ids of bytes, pairs in order of their code with rank and merged id, bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[x] for x in token)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * self.size
        for token, number in vocab.items():
            if token not in self.special:
                self.token[number] = as_bytes(token)
        for token, number in self.special.items():
            self.token[number] = token.encode()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it isn't one."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], _NONE)

    @cached_property
    def by_pair(self) -> dict[int, int]:
        return dict(zip(self.code.tolist(), self.rank.tolist(), strict=True))


def merge_rows(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of words of up to WIDE bytes, little-endian: one segment tree each, as rows of one array."""
    n = np.array([len(x) for x in words])
    width = 1 << int(max(1, n.max() - 1)).bit_length() if n.max() > 1 else 2
    buffer = np.zeros((len(words), width), dtype=np.uint8)
    buffer[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    place = np.arange(width)
    symbol = np.where(place < n[:, None], vocab.of_byte[buffer], -1)
    right = np.where(place + 1 < n[:, None], place + 1, -1)
    left = np.tile(place - 1, (len(words), 1))

    def leaf(row: np.ndarray, i: np.ndarray) -> np.ndarray:
        r = right[row, i]
        rank = vocab.ranks(symbol[row, i], symbol[row, np.maximum(r, 0)])
        return np.where((r >= 0) & (rank < _NONE), rank * _PLACE + i, _NONE)

    tree = np.full((len(words), 2 * width), _NONE)
    rows, cells = np.nonzero(right >= 0)
    tree[rows, width + cells] = leaf(rows, cells)
    for k in range(width - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    row = np.flatnonzero(tree[:, 1] < _NONE)
    while len(row):
        root = tree[row, 1]
        i, rank = root % _PLACE, root // _PLACE
        gone = right[row, i]
        after = right[row, gone]
        symbol[row, i] = vocab.merged[rank]
        symbol[row, gone] = -1
        right[row, i] = after
        more = after >= 0
        left[row[more], after[more]] = i[more]
        before = left[row, i]
        has = before >= 0
        r = np.concatenate([row, row, row[has]])
        c = np.concatenate([i, gone, before[has]])
        value = np.concatenate([leaf(row, i), np.full(len(row), _NONE), leaf(row[has], before[has])])
        at = c + width
        tree[r, at] = value
        while at[0] > 1:
            at = at >> 1
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
        row = row[tree[row, 1] < _NONE]
    keep = symbol >= 0
    ids = symbol[keep].astype("<u4").tobytes()
    ends = (4 * np.cumsum(keep.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_long(word: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one word of any length, by the same tree."""
    n = len(word)
    symbol = vocab.of_byte[np.frombuffer(word, dtype=np.uint8)]
    width = 1 << (n - 1).bit_length()
    leaves = np.full(width, _NONE)
    first = vocab.ranks(symbol[:-1], symbol[1:])
    leaves[: n - 1] = np.where(first < _NONE, first * _PLACE + np.arange(n - 1), _NONE)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    tree = [x.tolist() for x in levels]
    ids, pair, merged, none = symbol.tolist(), vocab.by_pair, vocab.merged, int(_NONE)
    right, left = [*range(1, n), -1], list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        tree[0][i] = value
        for k in range(1, len(tree)):
            i >>= 1
            low = min(tree[k - 1][2 * i], tree[k - 1][2 * i + 1])
            if tree[k][i] == low:
                break
            tree[k][i] = low

    def leaf(i: int) -> int:
        j = right[i]
        rank = pair.get(ids[i] * vocab.size + ids[j]) if j >= 0 else None
        return none if rank is None else rank * _PLACE + i

    while (root := tree[-1][0]) < none:
        i = root % _PLACE
        gone = right[i]
        ids[i], ids[gone] = int(merged[root // _PLACE]), -1
        right[i] = right[gone]
        if right[i] >= 0:
            left[right[i]] = i
        put(gone, none)
        put(i, leaf(i))
        if left[i] >= 0:
            put(left[i], leaf(left[i]))
    return [x for x in ids if x >= 0]


class Codec:
    """Encodes and decodes whole texts; made once a task."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.split = regex.compile(SPLIT).findall
        marks = sorted(map(regex.escape, vocab.special), key=len, reverse=True)
        self.mark = regex.compile(f"({'|'.join(marks)})") if marks else None
        self.known: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Puts the ids of words that aren't known yet into the cache, as bytes of little-endian numbers."""
        new = [(x, x.encode()) for x in set(words) if x not in self.known]
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for x in new:
            if len(x[1]) > WIDE:
                self.known[x[0]] = np.array(merge_long(x[1], self.vocab), dtype="<u4").tobytes()
            else:
                by_width.setdefault((len(x[1]) - 1).bit_length(), []).append(x)
        for group in by_width.values():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                self.known.update(zip([word for word, _ in part], merge_rows([b for _, b in part], self.vocab), strict=True))

    def pieces(self, text: str) -> list[list[str] | int]:
        """Words of each stretch between special tokens, and those tokens' ids."""
        if self.mark is None or not any(x in text for x in self.vocab.special):
            return [self.split(text)]
        return [self.vocab.special[x] if i % 2 else self.split(x) for i, x in enumerate(self.mark.split(text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        cut = [self.pieces(x) for x in texts]
        self.learn(word for text in cut for part in text if not isinstance(part, int) for word in part)
        get = self.known.__getitem__
        ids = lambda part: np.uint32(part).astype("<u4").tobytes() if isinstance(part, int) else b"".join(map(get, part))
        return [b"".join(map(ids, text)) for text in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocab.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


def _coded(docs: DataFrame, path: str, row, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = codec.encode(part.column(1).to_pylist())
                columns = zip(*(row(codec, x) for x in ids), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=names)

    return texts(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its text."""
    return _coded(docs, path, lambda _, ids: (np.frombuffer(ids, dtype="<u4").astype(np.int32),), "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number and digest of its ids, and digest of the text that they decode to."""

    def row(codec: Codec, ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

    return _coded(docs, path, row, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), vocabulary_path())
