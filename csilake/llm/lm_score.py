"""Cross-entropy difference of each document between a target model and a background model.

Both are bigram models over all words of the corpus and the text's edge. The background is counted over all rows, the
target over those that the caller marks; both share the corpus' vocabulary. A bigram's probability is its count blended with the word's add-one share:
``(c(v, w) + BLEND * p(w)) / (c(v) + BLEND)``. A token's loss is -log2 of that; the score is the mean over a
document's tokens (its words and the closing edge) of target loss minus background loss, so lower is nearer to the target.

Each token but the edges is once a bigram's right word and once a left one, and so is the edge of a text. So a document's loss
is a sum over its bigrams (v, w) of ``log2(c(w) + BLEND) - log2(c(v, w) + BLEND * p(w))``.

Texts are dealt to chunks of some CHUNK_BYTES. A chunk asks for the counts of its distinct words and bigrams, each once, however often it has
it: keys are hashes, sorted, and each range of them (a bucket) goes as one packed row to the task that sums it. That task answers each
chunk with the sums, in the order of the keys it was sent, so no key goes back, and the chunk, which makes the same keys in the same
order again, reads its texts' losses from them. A frequent word or bigram is one key a chunk, so none is hot, and all are counted; what is gathered grows with the corpus.
A bucket holds some BUCKET_KEYS keys on average, whatever the corpus. Answers are written to the shared folder.

A null or empty text has one token, the closing edge. Rows may repeat; each counts. Ids may be null; such rows are no target rows. Without target rows the
target model is uniform. An empty table gives no rows. Further columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.common import SPACED, dealt, mix, stored, table, words

BLEND = 5.0
#: Bytes of text of a chunk, about.
CHUNK_BYTES = 8 << 20
#: Keys of a bucket, about; a text of n bytes is taken to have n / 4 keys.
BUCKET_KEYS = 1 << 20
WORD, PAIR = 0, 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all their first bytes, all second ones, and so on, so that small numbers cost little."""
    whole = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(whole.T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


class Counted:
    """Bigrams of the texts of a chunk: distinct words and distinct pairs in order of their hashes, and where each token has its own."""

    def __init__(self, rows: pa.Table):
        column = rows.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        *_, hashes, first = words(column, SPACED)
        hashes = np.where(hashes == 0, np.uint64(1), hashes)  # 0 is the edge
        left, right = np.insert(hashes, first[:-1], np.uint64(0)), np.insert(hashes, first[1:], np.uint64(0))
        self.text = np.repeat(np.arange(rows.num_rows), np.diff(first) + 1)
        self.n_tokens = np.diff(first) + 1
        self.keys, self.of = [], []
        for key in (right, mix(mix(left) * _FACTOR + right)):
            distinct, of = np.unique(key, return_inverse=True)
            self.keys.append(distinct)
            self.of.append(of)

    def counts(self, kind: int, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs, in all texts and in target texts."""
        n = len(self.keys[kind])
        return np.bincount(self.of[kind], minlength=n), np.bincount(self.of[kind][target[self.text]], minlength=n)


def _cells(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to): ranges of sorted keys, of which there are a power of two."""
    if not len(keys):
        return []
    own = (keys >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(keys), dtype=np.int64)
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return list(zip(own[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True))


_ASKED = "kind int, bucket bigint, chunk bigint, keys binary, n binary, target binary"
_ANSWERED = "kind int, bucket bigint, chunk bigint, n binary, target binary, fresh bigint, tokens bigint, target_tokens bigint"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _summed(rows: pa.Table) -> pa.Table:
    """Answers to all chunks that ask for keys of one bucket; the number of distinct keys and their sums stand on the first."""
    kind, bucket, chunk = (rows.column(x).to_pylist() for x in ("kind", "bucket", "chunk"))
    asked = [np.cumsum(unpacked(x), dtype=np.uint64) for x in rows.column("keys").to_pylist()]
    distinct, of = np.unique(np.concatenate(asked), return_inverse=True)
    ends = np.cumsum([len(x) for x in asked])[:-1]
    sums = []
    for name in ("n", "target"):
        own = np.concatenate([unpacked(x) for x in rows.column(name).to_pylist()]).astype(np.int64)
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, of, own)
        sums.append((int(total.sum()), np.split(total[of], ends)))
    out = []
    for i, (n, target) in enumerate(zip(sums[0][1], sums[1][1], strict=True)):
        whole = (len(distinct), sums[0][0], sums[1][0]) if i == 0 else (0, 0, 0)
        out.append((kind[i], bucket[i], chunk[i], packed(n), packed(target), *whole))
    return _table(out, _ANSWERED)


_SCORED = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


def scores(docs: DataFrame, target: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of all rows, by models of all words of docs; ``target`` has the marked doc_ids."""
    texts_of, total = dealt(docs, chunk_bytes)
    buckets = 1 << max(0, (total // 4 // bucket_keys)).bit_length()
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # chunks learn which of their ids are marked; the same plan at every size, never a broadcast of ids
    marked = texts_of.select("chunk", "doc_id").distinct().join(ids.hint("merge"), "doc_id").select(F.col("chunk").alias("of"), F.col("doc_id").alias("marked"))

    def ask(rows: pa.Table, found: pa.Table) -> pa.Table:
        x = Counted(rows)
        known = np.isin(rows.column("doc_id").to_numpy(), found.column("marked").to_numpy()) if found.num_rows else np.zeros(rows.num_rows, dtype=bool)
        known &= ~np.asarray(rows.column("doc_id").is_null())
        chunk = rows.column("chunk")[0].as_py() if rows.num_rows else 0
        out = []
        for kind in (WORD, PAIR):
            keys, (n, marks) = x.keys[kind], x.counts(kind, known)
            for bucket, a, b in _cells(keys, buckets):
                out.append((kind, bucket, chunk, packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(n[a:b]), packed(marks[a:b])))
        return _table(out, _ASKED)

    asked = texts_of.groupBy("chunk").cogroup(marked.groupBy("of")).applyInArrow(ask, _ASKED)
    answers = stored(asked.groupBy("kind", "bucket").applyInArrow(_summed, _ANSWERED), "lm-counts")
    sums = answers.filter(F.col("kind") == WORD).agg(F.sum("fresh"), F.sum("tokens"), F.sum("target_tokens")).head()
    # words, and two classes that no text has: any other word, and the edge as one (which is a key too)
    size = (sums[0] or 0) + 1
    totals = [sums[2] or 0, sums[1] or 0]

    def losses(rows: pa.Table, found: pa.Table) -> pa.Table:
        x = Counted(rows)
        kinds, order = found.column("kind").to_numpy(), np.lexsort((found.column("bucket").to_numpy(), found.column("kind").to_numpy()))
        count = {}
        for name in ("target", "n"):
            cells = found.column(name).to_pylist()
            for kind in (WORD, PAIR):
                parts = [unpacked(cells[i]) for i in order.tolist() if kinds[i] == kind]
                count[name, kind] = np.concatenate(parts).astype(np.float64)
        means = []
        for name, all_ in zip(("target", "n"), totals, strict=True):
            single, pair = count[name, WORD][x.of[WORD]], count[name, PAIR][x.of[PAIR]]
            loss = np.log2(single + BLEND) - np.log2(pair + BLEND * (single + 1) / (all_ + size))
            means.append(np.bincount(x.text, weights=loss, minlength=rows.num_rows) / x.n_tokens)
        t, g = means
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(x.n_tokens), "target_loss": pa.array(t), "background_loss": pa.array(g), "score": pa.array(t - g)})

    return texts_of.groupBy("chunk").cogroup(answers.select("kind", "bucket", "chunk", "n", "target").groupBy("chunk")).applyInArrow(losses, _SCORED)


def op7_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against the models of all documents and of those labelled as of good quality."""
    docs = table(spark, folder, "documents")
    good = table(spark, folder, "labels").filter("quality = 1")
    return scores(docs, good)
