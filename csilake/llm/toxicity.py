"""Toxicity scores: logistic regression by FTRL-proximal over hashed words, word pairs and skip pairs.

Features are a text's distinct words and word starts, adjacent pairs, and pairs with one word between, hashed to
FEATURE_BITS bits. Training sees a bounded sample of the labelled rows (TRAIN_ROWS, lowest hash of the id first, so the sample doesn't depend
on partitions), fetched one partition at a time. Each coordinate has its own rate, and L1 leaves few weights other than zero:
these alone are broadcast, and all rows are scored where they lie, without a shuffle.

Rows with crc32(id as text) mod 4 = 2 are held out. Labels are read for training alone. A null text is empty; it
scores by the bias. Without a labelled row of either class the bias is a low prior. Null ids hash as an empty text.
A row with two labels is trained on twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.common import PLAIN, chunks, lowest, mix, ranges_hash, stored, table, texts, unused, words

TRAIN_ROWS = 8_000
FEATURE_BITS = 24
EPOCHS, RATE, SMOOTH, L1, L2 = 3, 0.6, 1.0, 4.0, 0.1
THRESHOLD = 0.3
#: Lengths in bytes of the word starts that count as words of their own, for inflected and compound words.
STEMS = (5, 7)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each occurrence in a column of texts."""
    data, start, end, hashes, first = words(column, PLAIN)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    out = [(text, hashes)]
    for n in STEMS:
        long = end - start > n
        out.append((text[long], ranges_hash(data, start[long], start[long] + n) ^ np.uint64(n)))
    for gap, seed in ((1, 0x51ED270B7A14C3A5), (2, 0xD6E8FEB86659FD93)):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, dtype=bool)
        left, right = hashes[:-gap][same], hashes[gap:][same]
        out.append((text[gap:][same], mix(left * np.uint64(seed) + right)))
    numbers = np.concatenate([x for _, x in out]) >> np.uint64(64 - FEATURE_BITS)
    return np.concatenate([x for x, _ in out]), numbers.astype(np.int64)


@dataclass
class Weights:
    """Features with a weight, in order, their weights, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    @cached_property
    def held(self) -> np.ndarray:
        out = np.zeros(1 << FEATURE_BITS, dtype=bool)
        out[self.feature] = True
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        text, feature = features(column)
        total = np.full(len(column), self.bias)
        if len(self.feature):
            some = self.held[feature]
            pairs = np.unique((text[some] << FEATURE_BITS) + feature[some])
            at = np.searchsorted(self.feature, pairs & ((1 << FEATURE_BITS) - 1))
            np.add.at(total, pairs >> FEATURE_BITS, self.weight[at])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Ftrl:
    """State per coordinate; one row at a time. The last coordinate is the bias, free of L1."""

    def __init__(self, size: int, bias: float):
        self.z, self.n, self.start = np.zeros(size + 1, dtype=np.float32), np.zeros(size + 1, dtype=np.float32), bias

    def weight(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((SMOOTH + np.sqrt(n)) / RATE + L2))

    def learn(self, feature: np.ndarray, label: int) -> None:
        at = np.append(feature, len(self.z) - 1)
        w, n = self.weight(at), self.n[at]
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.start, -30, 30)))
        g = p - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / RATE * w
        self.n[at] += g * g


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """label and ``features`` (bytes of distinct 32-bit numbers) of at most ``rows`` labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("label is not null and doc_id is not null")
    chosen = lowest(known.filter(~held_out(F.col("doc_id"))), ["doc_id", "label"], rows).withColumn("order", F.xxhash64("doc_id", "label"))
    joined = texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "label", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch, "text"):
                part = batch.slice(a, b - a)
                text, feature = features(part.column(0))
                pairs = np.unique((text << FEATURE_BITS) + feature)
                cut = np.searchsorted(pairs, np.arange(part.num_rows + 1) << FEATURE_BITS)
                low = (pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
                held = [low[cut[i] : cut[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(held, pa.binary())], names=["label", "order", "features"])

    return joined.mapInArrow(run, "label int, order bigint, features binary")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Weights:
    kept = stored(sample(docs, labels, rows), "toxicity-sample").orderBy("order")
    n, toxic = kept.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (toxic + 1) / (n + 20)
    model = Ftrl(1 << FEATURE_BITS, float(np.log(prior / (1 - prior))))
    for _ in range(EPOCHS if 0 < toxic < n else 0):
        for row in kept.toLocalIterator():
            model.learn(np.frombuffer(row.features, dtype=np.int32), row.label)
    held = np.flatnonzero((model.z[:-1] > L1) | (model.z[:-1] < -L1))
    weight = model.weight(held)
    bias = float(model.weight(np.array([len(model.z) - 1]))[0]) + model.start
    return Weights(held, weight, bias)


def scored(docs: DataFrame, weights: Weights) -> DataFrame:
    """The rows with ``score`` last; all columns stay, a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.drop("score")
    names = rows.columns
    (whole,) = unused(rows, "_text")
    rows = rows.withColumn(whole, F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch, whole):
                part = batch.slice(a, b - a)
                score = pa.array(shared.value.score(part.column(len(names))))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), score], names=[*names, "score"])

    schema = docs.drop("score").schema.add("score", "double")
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below THRESHOLD, with all their columns."""
    own = [x for x in docs.columns if x.lower() == "score"]
    aside = dict(zip(own, unused(docs, *("_score" for _ in own)), strict=True))
    kept = scored(docs.withColumnsRenamed(aside), train(docs, labels)).filter(F.col("score") < THRESHOLD).drop("score")
    return kept.withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    weights = train(docs, table(spark, folder, "labels"))
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
