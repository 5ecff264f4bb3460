"""Clustering by centroids, each vector's nearest one found by a vantage-point tree.

Vectors are integers (floor(SCALE * x)), and so are centroids, so every distance that decides is exact. Each round builds a tree over the
centroids on the driver and broadcasts it. An inner node is a centroid, with the least and greatest distance from it to those
inside and to those outside the median; a leaf is at most LEAF centroids. Each vector goes through the tree best first: of its
open nodes the one of least bound is next, the exact distance to the centroids there is taken, and the search ends when no
open node's bound is within the best distance found. The radius is inclusive and bounds are lowered by more than floating point
can err, so a centroid at the same distance is always met, and of those the smallest number wins. The vectors of a batch take
their steps side by side as rows of one array.

Sums and counts of each cluster are exact: summed in each task, then by Spark, at most k * dimensions rows. Only these and
the centroids are on the driver. A round reads the table again, in place; nothing is shuffled but the sums, and a lost task is run again.

A vector counts if it has exactly the stated number of components, none null or not finite; others give no row. Rows may repeat, and
each counts; a null id is an id, whose key for the start is after all others. With fewer vectors than k there are as many centroids as vectors; an empty table
gives no rows. Integers beyond 2^27 (x of over 131,072) count as that, since distances must fit 64 bits. Inertia beyond 64 bits is
given as the greatest number. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.common import ship, stored, table

K, ROUNDS, DIMENSIONS, SCALE, SALT = 8, 10, 64, 1024, 3
LEAF = 2
_FAR = 1 << 27
_MOST = (1 << 63) - 1
#: By how much of the lengths compared a bound is lowered; floating point errs by less than a hundredth of that.
_SLACK = 1e-13


def integers(column: pa.Array, dimensions: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that count, as rows of integers, and their places in the column."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are not finite either
    start = size.cumsum() - size
    row = np.flatnonzero(size == dimensions)
    value = flat[start[row][:, None] + np.arange(dimensions)]
    fine = np.isfinite(value).all(axis=1)
    return np.clip(np.floor(value[fine] * scale), -_FAR, _FAR).astype(np.int64), row[fine]


@dataclass
class Node:
    """Centroids to compare with at once, and the nodes below with the range of their distances to the first of these."""

    numbers: np.ndarray
    below: list[tuple[int, float, float]]


class Tree:
    """Vantage-point tree over centroids."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids, self.leaf, self.nodes = centroids, leaf, []
        if len(centroids):
            self._grow(np.arange(len(centroids)))

    def _grow(self, numbers: np.ndarray) -> int:
        own = len(self.nodes)
        self.nodes.append(Node(numbers, []))
        if len(numbers) > self.leaf:
            vantage, rest = numbers[:1], numbers[1:]
            squared = ((self.centroids[rest] - self.centroids[vantage]) ** 2).sum(axis=1)
            inside = squared <= np.sort(squared)[(len(rest) - 1) // 2]
            below = []
            for part in (inside, ~inside):
                if part.any():
                    low, high = np.sqrt(squared[part].min()), np.sqrt(squared[part].max())
                    below.append((self._grow(rest[part]), float(low), float(high)))
            self.nodes[own] = Node(vantage, below)
        return own

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of each vector's nearest centroid, the squared distance, and how many distances were taken."""
        n, taken = len(vectors), 0
        best, number = np.full(n, _MOST), np.full(n, len(self.centroids))
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0
        active = np.arange(n)
        while len(active):
            node = bound[active].argmin(axis=1)
            within = bound[active, node] <= np.sqrt(best[active].astype(np.float64)) * (1 + _SLACK)
            active, node = active[within], node[within]
            for k in np.unique(node).tolist():
                row = active[node == k]
                lowest = bound[row, k]
                bound[row, k] = np.inf
                for place, c in enumerate(self.nodes[k].numbers.tolist()):
                    squared = ((vectors[row] - self.centroids[c]) ** 2).sum(axis=1)
                    taken += len(row)
                    nearer = (squared < best[row]) | ((squared == best[row]) & (c < number[row]))
                    best[row[nearer]], number[row[nearer]] = squared[nearer], c
                    if place == 0 and self.nodes[k].below:
                        away = np.sqrt(squared.astype(np.float64))
                        for child, low, high in self.nodes[k].below:
                            apart = np.maximum(away - high, low - away) - _SLACK * (away + high)
                            bound[row, child] = np.maximum(np.maximum(apart, lowest), 0)
        return number, best, taken


def first_centroids(vectors: DataFrame, column: str, dimensions: int, k: int, salt: int) -> np.ndarray:
    """The k vectors whose salted id has the least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, row = integers(batch.column(1), dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(list(value), pa.list_(pa.int64()))], names=["id", "v"])

    kept = vectors.select("vec_id", column).mapInArrow(run, "id bigint, v array<bigint>")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    found = kept.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], dtype=np.int64).reshape(len(found), dimensions)


def _sums(vectors: DataFrame, column: str, tree: Tree) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster."""
    k, dimensions = tree.centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            value, _ = integers(batch.column(0), dimensions)
            number, *_ = shared.value.nearest(value)
            np.add.at(sums, number, value)
            count += np.bincount(number, minlength=k)
        own = np.repeat(np.arange(k), dimensions + 1)
        place = np.tile(np.arange(dimensions + 1), k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, place, np.column_stack([count, sums]).ravel())], names=["cluster", "place", "total"])

    partial = vectors.select(column).mapInArrow(run, "cluster bigint, place bigint, total bigint")
    rows = partial.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {(r["cluster"], r["place"]): int(r["total"]) for r in rows}
    return {c: (found.get((c, 0), 0), [found.get((c, i + 1), 0) for i in range(dimensions)]) for c in range(k)}


def clustered(vectors: DataFrame, column: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, salt: int = SALT, leaf: int = LEAF) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that counts."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias(column))
    centroids = first_centroids(vectors, column, dimensions, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        moved = _sums(vectors, column, Tree(centroids, leaf))
        centroids = np.array([[s // moved[c][0] for s in moved[c][1]] if moved[c][0] else centroids[c].tolist() for c in range(len(centroids))], dtype=np.int64)
    shared = spark.sparkContext.broadcast(Tree(centroids, leaf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, row = integers(batch.column(1), dimensions)
            if len(row):
                number, squared, _ = shared.value.nearest(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(squared)], names=["vec_id", "cluster", "distance"])

    rows = stored(vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), "clusters")
    inertia = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(inertia.values()), _MOST)
    # one row a centroid: at most k
    about = [(c, min(inertia.get(c, 0), _MOST), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(table(spark, folder, "embeddings"))


def sql(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, salt: int = SALT) -> str:
    """The same in DuckDB, each round written out, every vector compared with every centroid."""
    nearest = """a{n} AS MATERIALIZED (SELECT r, min([list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c.c]) AS m
FROM kept x, c{n} c GROUP BY r)"""
    moved = """c{next} AS MATERIALIZED (SELECT c.c, coalesce(z.v, c.v) AS v FROM c{n} c LEFT JOIN (
SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
SELECT m[2] AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM kept JOIN a{n} USING (r), unnest(range(1, {end})) AS t(i) GROUP BY 1, 2) GROUP BY c) z USING (c))"""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        f" WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept) WHERE c < {k})",
    ]
    for n in range(rounds):
        parts += [nearest.format(n=n), moved.format(n=n, next=n + 1, end=dimensions + 1)]
    parts += [nearest.format(n=rounds), f"z AS (SELECT vec_id, m[2]::INTEGER AS cluster, m[1] AS distance FROM kept JOIN a{rounds} USING (r))"]
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,\n"
        f"sha256(array_to_string(v, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON c = cluster"
    )


OP11_SQL = sql()
