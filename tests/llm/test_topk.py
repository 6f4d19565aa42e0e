"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from energylake.llm import topk


def plain(rows, every, k=5):
    """Rows: (id, vector); the k best of all rows with another id, each distinct row once."""
    width = max((len(v) for _, v in rows if v), default=0)
    whole = sorted(
        {
            (i, tuple(math.floor(256 * x) for x in v) + (0,) * (width - len(v)))
            for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        }
    )
    out = []
    for q, a in whole:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return sorted(out)


def found(spark, rows, every=50, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("vec", F.lit("x"))
    return sorted(map(tuple, topk.top_k(df.repartition(3), F.col("id") % every == 0, **options).collect()))


def floats(values):
    return [float(np.float32(x)) for x in values]


def clusters(seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dim))
    return [(i, floats(centres[i % 5] + rng.normal(0, 0.05, dim))) for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 4, 16])
def test_clusters(spark, pivots):
    rows = clusters(1)
    assert found(spark, rows, every=10, pivots=pivots) == plain(rows, 10)


def test_ties_and_a_hot_vector(spark):
    rows = [(i, [0.5, 0.5, 0.0] if i % 3 == 0 else [0.25 * (i % 4), 0.0, 1.0]) for i in range(150)]
    assert found(spark, rows, every=7) == plain(rows, 7)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
        (None, [1.0, 1.0]), (5, []), (6, [1.0]), (7, [1.0, -1.0]), (7, [1.0, -1.0]), (8, [-0.001, 3.0]), (50, [0.0, 0.0]),
    ]
    assert found(spark, rows) == plain(rows, 50)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert found(spark, rows) == [(0, 1, 1, 256 * 512)]


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0])]) == []
    assert found(spark, [(0, [1.0])]) == []


def test_vectors_that_cannot_count_are_not_sent():
    pivots = np.array([[0.0, 0.0], [100.0, 0.0]])
    near = [(0, float(d)) for d in range(6)]
    table = {(q, g): least for q, g, least in topk._reaches(pivots, {0: 1.0}, near, 5, 0.0)}
    # six vectors lie within 1 + 5 of the queries; those at the far pivot are 99 and more away
    assert table[0, 0] < 0
    assert table[0, 1] == 100 - 1 - 6


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.top_k(df, F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == plain(rows, 50)
