"""Alignment of the tokens of two tokenizers, and of their links over the corpus.

Both encode a space and the text; a token is a range of its bytes, and where tokens of both end the text is cut into groups. The
cuts are found by skipping along diagonals: from a cut on, as long as tokens match one to one, the two arrays of ends are equal at
one index shift. Slices of twice the length each time are compared at that shift until one differs, then halves, so a stretch is
jumped in few comparisons. What follows is an irregular group: whichever side ends earlier goes on until both end together, and the
shift is what it is then.

Tokens that overlap are linked. A pair of ids counts by its links in the whole corpus. Pairs are summed per text and in each task
before the one shuffle by pair. Their counts come back in two ways, alike in result: the most frequent ones, at most PAIRS, as a broadcast
table, all others by a join on the pair; none of those holds more than 2 / PAIRS of all links, so no key is hot.

Tables of both vocabularies are broadcast (their files' sizes). A null or empty text, or one that either tokenizer changes, has no tokens:
zeros and an empty digest, no links. Rows may repeat, ids may be null; each row counts. An empty table gives no rows. Further columns are
ignored. Texts are aligned whole; a very long one is a batch of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.bpe import SPLIT, byte_letters, vocabulary_path
from csilake.llm.common import chunks, stored, table, texts

#: Frequent pairs whose counts are broadcast, at most.
PAIRS = 1 << 18
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 20
#: Distinct pairs that a task counts before it hands them on.
HELD_PAIRS = 1 << 20
#: Blanks in a row above which the faster encoder's pattern runs out of stack.
BLANKS = 10_000


class ByteTokens:
    """Ids of a byte-level vocabulary file, and the bytes of each."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = {bytes(letters[x] for x in token): number for token, number in spec["model"]["vocab"].items() if all(x in letters for x in token)}
        for added in spec["added_tokens"]:
            vocab.pop(added["content"].encode(), None)
        merged = [spec["model"]["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids of merged tokens must be in the order of the merges")
        self.path, self.size = path, max(spec["model"]["vocab"].values()) + 1
        self.bytes = [b""] * self.size
        for token, number in vocab.items():
            self.bytes[number] = token
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={})
        self.blanks = re.compile(rf"\s{{{BLANKS}}}")
        self.slow = None

    def encode(self, text: str) -> list[int]:
        if len(text) < BLANKS or not self.blanks.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
            self.slow.no_truncation()
            self.slow.no_padding()
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids of a model file of pieces, and the bytes of each; the model adds the space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.piece_size()
        as_byte = re.compile("<0x([0-9A-F]{2})>")
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(x)) else x.replace("▁", " ").encode() for x in pieces]

    def encode(self, part: list[str]) -> list[list[int]]:
        return self.model.encode(part, num_threads=1)


def cuts(one: list[int], two: list[int]) -> list[tuple[int, int, int]]:
    """Groups of two arrays of ends with one last end: how many tokens of each are past, and how many one-to-one groups end there (1 for an irregular one)."""
    i = j = 0
    last, out = len(one), []
    while i < last:
        if one[i] == two[j]:
            begin, step = i, 1
            while (ahead := one[i : i + step]) == two[j : j + step]:
                i, j = i + len(ahead), j + len(ahead)
                if len(ahead) < step:
                    break
                step *= 2
            while step > 1 and i < last:
                step //= 2
                ahead = one[i : i + step]
                if ahead == two[j : j + step]:
                    i, j = i + len(ahead), j + len(ahead)
            out.append((i, j, i - begin))
        else:
            x, y = one[i], two[j]
            while x != y:
                if x < y:
                    i += 1
                    x = one[i]
                else:
                    j += 1
                    y = two[j]
            i, j = i + 1, j + 1
            out.append((i, j, 1))
    return out


class Aligner:
    """Encodes and aligns texts; made once a task."""

    def __init__(self, one: str, two: str):
        self.a, self.b = ByteTokens(one), PieceTokens(two)
        self.size = [np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        most = max(self.a.size, self.b.size)
        self.width = len(str(most))
        numbers = np.char.ljust(np.arange(most).astype(f"S{self.width + 1}"), self.width + 1, b"0")
        self.digits = np.frombuffer(numbers.tobytes(), dtype=np.uint8).reshape(most, -1)
        self.n_digits = np.array([len(str(i)) for i in range(most)])

    def encoded(self, part: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by both; of a text that one of them changes, and of an empty one, none."""
        full = [x for x in part if x]
        a, b = [self.a.encode(" " + x) for x in full], self.b.encode(full) if full else []
        for k, x in enumerate(full):
            whole = b" " + x.encode()
            if any(b"".join(map(side.bytes.__getitem__, ids)) != whole for side, ids in ((self.a, a[k]), (self.b, b[k]))):
                a[k] = b[k] = []
        both = iter(zip(a, b, strict=True))
        pairs = [next(both) if x else ([], []) for x in part]
        return [x for x, _ in pairs], [y for _, y in pairs]

    def aligned(self, part: list[str]) -> dict[str, list]:
        """Columns of the result for texts, with the codes of linked pairs and how often each occurs."""
        a, b = self.encoded(part)
        n = np.array([[len(x) for x in a], [len(x) for x in b]], dtype=np.int64).reshape(2, -1)
        first = np.concatenate([np.zeros((2, 1), dtype=np.int64), n.cumsum(axis=1)], axis=1)
        ids = [np.fromiter((i for x in side for i in x), dtype=np.int64, count=m) for side, m in zip((a, b), n.sum(axis=1), strict=True)]
        ends = [size[x].cumsum() for size, x in zip(self.size, ids, strict=True)]
        groups, found = np.zeros(len(part), dtype=np.int64), []
        for k in np.flatnonzero(n[0]).tolist():
            own = cuts(*(x[f[k] : f[k + 1]].tolist() for x, f in zip(ends, first, strict=True)))
            runs = np.array(own)
            groups[k] = runs[:, 2].sum()
            runs[:, :2] += first[:, k]
            found.append(runs)
        runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
        back = np.repeat(runs[:, 2].cumsum(), runs[:, 2]) - np.arange(runs[:, 2].sum()) - 1
        end_a, end_b = (np.repeat(runs[:, c], runs[:, 2]) - back for c in (0, 1))
        links = n.sum(axis=0) - groups
        codes, reps = self.pairs(ids, ends, links)
        return {"n_a": n[0], "n_b": n[1], "n_groups": groups, "n_links": links, "groups_sha256": self.digests(ids, n, end_a, end_b), "codes": codes, "reps": reps}

    def digests(self, ids: list[np.ndarray], n: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> list[str]:
        """Digest of each text's groups, written one after the other."""
        total = n.sum(axis=0)
        group = [np.searchsorted(end, np.arange(len(x)), side="right") for end, x in zip((end_a, end_b), ids, strict=True)]
        before_b = np.append(0, end_b[:-1]) if len(end_b) else end_b
        at = [np.arange(len(ids[0])) + before_b[group[0]], np.arange(len(ids[1])) + end_a[group[1]]]
        number, mark = np.empty(total.sum(), dtype=np.int64), np.full(total.sum(), ord(","), dtype=np.uint8)
        for where, x in zip(at, ids, strict=True):
            number[where] = x
        mark[at[0][end_a - 1]], mark[at[1][end_b - 1]] = ord("|"), ord(";")
        text, size = self.digits[number], self.n_digits[number]
        text[np.arange(len(number)), size] = mark
        whole = text[np.arange(self.width + 1) <= size[:, None]]
        ends = np.append(0, (size + 1).cumsum())[np.append(0, total.cumsum())].tolist()
        return [hashlib.sha256(whole[x : y - 1].tobytes()).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:], strict=False)]

    def pairs(self, ids: list[np.ndarray], ends: list[np.ndarray], links: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Codes of the pairs that are linked in each text, and the number of those links: each stretch between two ends is one link."""
        stops = [np.zeros((ends[0][-1] if len(ends[0]) else 0) + 1, dtype=np.int32) for _ in ids]
        for stop, x in zip(stops, ends, strict=True):
            stop[x] = 1
        stop = np.flatnonzero(stops[0] | stops[1])
        a, b = (x[s.cumsum()[stop - 1]] for x, s in zip(ids, stops, strict=True))
        row = np.repeat(np.arange(len(links), dtype=np.int64), links)
        code = a * self.b.size + b
        order = np.lexsort((code, row)) if self.a.size * self.b.size > 1 << 32 else np.argsort((row << 32) | code)
        row, code = row[order], code[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        head = np.flatnonzero(new)
        reps, code = np.diff(np.append(head, len(code))).astype("<u4"), code[head].astype("<i8")
        at = np.append(0, np.bincount(row[head], minlength=len(links)).cumsum()).tolist()
        return [code[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], [reps[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]


_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, reps binary"
_TYPES = [*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]


def alignments(docs: DataFrame, one: str, two: str) -> DataFrame:
    """Each row's numbers of tokens, groups and links, the digest of its groups, and its linked pairs (sorted codes, a * size of b + b) with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(one, two)
        for batch in batches:
            for x, y in chunks(batch, "text", BATCH_BYTES):
                part = batch.slice(x, y - x)
                found = aligner.aligned(part.column(1).to_pylist())
                columns = [part.column(0), *(pa.array(c, k) for c, k in zip(found.values(), _TYPES[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *found])

    return texts(docs).mapInArrow(run, _ALIGNED)


def _lists(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows of a binary column, and each one's row."""
    parts = [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, kind)).astype(np.int64), row


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair, summed up in the task."""
    code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (code, count)], names=["code", "links"])

    for batch in batches:
        more, n = (_lists(batch.column(i), kind)[0] for i, kind in enumerate(("<i8", "<u4")))
        code, place = np.unique(np.concatenate([code, more]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([count, n]), minlength=len(code)).astype(np.int64)
        if len(code) > HELD_PAIRS:
            yield from out()
            code, count = code[:0], count[:0]
    yield from out()


def pair_links(rows: DataFrame, width: int) -> DataFrame:
    """code, links and whether no other pair of that second id has more, of all pairs of ``alignments``."""
    counted = rows.select("codes", "reps").mapInArrow(_counted, "code bigint, links bigint").groupBy("code").agg(F.sum("links").alias("links"))
    counted = counted.withColumn("b", F.col("code") % F.lit(width))
    most = counted.groupBy("b").agg(F.max("links").alias("most"))
    return counted.join(most, "b").select("code", "links", (F.col("links") == F.col("most")).alias("best"))


def _frequent(pairs: DataFrame, limit: int) -> tuple[int, np.ndarray]:
    """The least number of links, a power of two, that at most ``limit`` pairs reach, and those pairs in order of their code."""
    size = {r["bits"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("links")).cast("int").alias("bits")).agg(F.count("*").alias("n")).collect()}
    bar, total = 64, 0
    while bar and total + size.get(bar - 1, 0) <= limit:
        bar, total = bar - 1, total + size.get(bar - 1, 0)
    found = pairs.filter(F.col("links") >= F.lit(float(2**bar))).toPandas().sort_values("code")
    return 2**bar, found.to_numpy(dtype=np.int64).reshape(-1, 3)


def _split(batch: pa.RecordBatch, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, code and links of all pairs of a batch, each one's place in the table of frequent pairs, and whether it is there."""
    code, row = _lists(batch.column("codes"), "<i8")
    n, _ = _lists(batch.column("reps"), "<u4")
    at = np.minimum(np.searchsorted(known[:, 0], code), max(len(known) - 1, 0))
    return row, code, n, at, known[at, 0] == code if len(known) else np.zeros(len(code), dtype=bool)


def aligned(docs: DataFrame, one: str, two: str, frequent: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    width = PieceTokens(two).size
    rows = stored(alignments(docs, one, two).withColumn("row", F.monotonically_increasing_id()), "alignments")
    pairs = stored(pair_links(rows, width), "pair-links")
    bar, known = _frequent(pairs, frequent)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def of_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, n, at, there = _split(batch, shared.value)
            row, n, pair = row[there], n[there], shared.value[at[there]]
            sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], row, n * pair[:, 2])
            np.add.at(sums[1], row, n * pair[:, 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, n, _, there = _split(batch, shared.value)
            rest = np.flatnonzero(~there)
            own = batch.column("row").to_numpy()[row[rest]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, code[rest], n[rest])], names=["row", "code", "n"])

    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    most = rows.mapInArrow(of_frequent, schema)
    rest = rows.select("row", "codes", "reps").mapInArrow(others, "row bigint, code bigint, n bigint").join(pairs.filter(F.col("links") < F.lit(float(bar))), "code")
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"))
    added = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return most.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned(table(spark, folder, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
