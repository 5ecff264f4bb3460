"""Operator 11 against a brute-force version and its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from csilake.llm import centroids

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def by_hand(rows, k, rounds, dimensions, salt=3):
    kept = []
    for doc, v, *_ in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((doc, [max(-(1 << 27), min(1 << 27, math.floor(1024 * x))) for x in v]))
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1])
    found = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(found))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        found = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(found)]
    out = [(doc, *nearest(v)[::-1]) for doc, v in kept]
    total = {i: sum(d for _, c, d in out if c == i) for i in range(len(found))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return sorted(((doc, c, d, total[c], sum(total.values()), digest[c]) for doc, c, d in out), key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(a, v, 0) for a, v in rows], VECTORS).repartition(3)
    return sorted((tuple(r) for r in centroids.clustered(docs, **more).collect()), key=str)


@pytest.mark.parametrize("k,dimensions,leaf", [(8, 4, 2), (1, 3, 2), (20, 2, 1), (5, 6, 9)])
def test_clusters_are_those_of_the_definition(spark, k, dimensions, leaf):
    rng = random.Random(k)
    grid = [-1.0, -0.5, -0.0004, 0.0, 0.25, 1.0]  # few values: many ties and equal vectors
    rows = [(i, [rng.choice(grid) if i % 2 else rng.gauss(0, 1) for _ in range(dimensions)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, rows[5][1]), (500, None), (501, []), (502, [1.0] * (dimensions + 1)), (503, [float("nan")] * dimensions)]
    rows += [(504, [float("inf")] * dimensions), (505, [None] + [1.0] * (dimensions - 1)), (506, [1e300] * dimensions), (507, [-1e300] + [0.0] * (dimensions - 1))]
    assert found(spark, rows, k=k, rounds=4, dimensions=dimensions, leaf=leaf) == by_hand(rows, k, 4, dimensions)


def test_few_or_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert found(spark, rows, dimensions=2) == by_hand(rows, 8, 10, 2)
    assert found(spark, rows, dimensions=3) == [] and found(spark, [], dimensions=2) == []
    docs = spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS).withColumns({"cluster": F.lit("x"), "distance": F.lit(1.5), "id": F.lit(None).cast("int")})
    assert len(centroids.clustered(docs, dimensions=2).collect()) == 1


def test_tree_finds_the_smallest_number_and_skips_distances():
    rng = np.random.default_rng(1)
    centers = rng.integers(-2000, 2000, (64, 3))
    centers[20:30] = centers[:10]
    vectors = np.concatenate([rng.integers(-2000, 2000, (3000, 3)), centers, centers + 1])
    tree = centroids.Tree(centers)
    number, best, taken = tree.nearest(vectors)
    squared = ((vectors[:, None] - centers) ** 2).sum(axis=2)
    assert (number == squared.argmin(axis=1)).all() and (best == squared.min(axis=1)).all()
    assert taken < 0.6 * squared.size


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(db.execute(centroids.OP11_SQL).fetchall())
    assert sorted(tuple(r) for r in centroids.op11_centroids(spark, folder).collect()) == want and len(want) > 100
