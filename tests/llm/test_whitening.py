"""Whitening against exact sums and eigenvectors in many digits."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from energylake.llm import whitening


def whole(rows):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v in kept), default=0)
    return [(i, v + [0] * (width - len(v))) for i, v in kept], width


def exact(rows):
    """Kept rows, distinct count, sums and covariance (in fractions, rounded once)."""
    kept, width = whole(rows)
    distinct = sorted({tuple(v) for _, v in kept})
    n = len(distinct)
    sums = [sum(v[j] for v in distinct) for j in range(width)]
    v = [
        [
            float(sum((Fraction(a[i]) - Fraction(sums[i], n)) * (Fraction(a[j]) - Fraction(sums[j], n)) for a in distinct) / n)
            for j in range(width)
        ]
        for i in range(width)
    ]
    return kept, n, sums, np.array(v).reshape(width, width)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("id", "x", "n", "component", "whitened"):
        df = df.withColumn(name, F.lit(None))
    return whitening.whiten(df.repartition(3), **options).collect()


def check(rows, got, components=4):
    kept, n, sums, v = exact(rows)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(v))
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    mean = np.array([s / n for s in sums])
    for c in range(1, k + 1):
        mine = sorted(by[c], key=lambda r: (str(r.vec_id), r.deviation, r.whitened or 0))
        assert {r.n for r in mine} == {n}
        assert sorted(r.deviation for r in mine) == sorted(sum((n * x - s) ** 2 for x, s in zip(a, sums, strict=True)) for _, a in kept)
        if values[c - 1] <= 1e-12 * np.trace(v):
            assert all(r.whitened is None and r.explained == 0 for r in mine)
            continue
        want = sorted(
            (str(i), sum((n * x - s) ** 2 for x, s in zip(a, sums, strict=True)), float((np.array(a) - mean) @ axes[:, c - 1] / values[c - 1] ** 0.5))
            for i, a in kept
        )
        assert mine[0].explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
        have = np.array([r.whitened for r in mine])
        if len({str(i) for i, _ in kept}) == len(kept):
            w = np.array([x for _, _, x in want])
            sign = np.sign(w @ have)
            assert have * sign == pytest.approx(w, abs=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def floats(values):
    return [float(np.float32(x)) for x in values]


def test_spread_out_vectors(spark):
    rng = np.random.default_rng(1)
    scale = np.array([3, 2.5, 1, 0.5, 0.3, 0.2])
    rows = [(i, floats(5 + rng.normal(0, 1, 6) * scale)) for i in range(200)]
    check(rows, found(spark, rows))


def test_repeats_count_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, floats(rng.normal(0, 1, 3))) for i in range(30)]
    more = rows + [(100 + i, rows[0][1]) for i in range(50)] + [(None, rows[1][1])]
    check(more, found(spark, more))


def test_odd_rows(spark):
    rows = [
        (None, [0.5, 0.25, -1.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]),
        (5, [1.0]), (5, [1.0]), (6, []), (7, [0.0, 0.0, 0.0]), (8, [-0.0, 2.0, -0.001]),
    ]
    check(rows, found(spark, rows))


def test_fewer_dimensions_than_components(spark):
    rows = [(i, [float(i * i)]) for i in range(9)]
    check(rows, found(spark, rows))


def test_no_rows_and_no_variance(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []
    assert found(spark, [(1, [])]) == []
    one = found(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)
    ]


def test_a_plane(spark):
    rows = [(i, [float(i), float(i % 5), float(i + i % 5)]) for i in range(40)]
    check(rows, found(spark, rows))


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


def defect(a, values, x):
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    size = np.abs(a).max() or 1
    return (
        float(np.abs(a @ x - x * values).max() / size),
        float(np.abs(x.T @ x - np.eye(len(a))).max()),
    )


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1],
        [1, 1 - 1e-6, 1 - 2e-6, 0.5, 0.1],
        [1, 1 - 1e-9, 1 - 3e-9, 0.5, 0.5 - 1e-10, 1e-3],
        [2, 2, 2, 1, 1, 0.5],
        [1e8, 1, 1e-4],
        [1, 1 - 1e-5, 1 - 1e-5 - 1e-11, 1 - 1e-5 - 2e-11, 0.2],
        list(np.linspace(1, 2, 64)),
        [0, 0, 0],
    ],
)
def test_eigenvectors(values):
    a = symmetric(values, len(values))
    got, x = whitening.eigen(a)
    assert list(got) == sorted(got, reverse=True)
    residue, skew = defect(a, got, x)
    assert residue < 5e-16 and skew < 5e-16
    assert got == pytest.approx(sorted(values, reverse=True), abs=1e-14 * max(1, max(values)))


def test_close_eigenvalues_keep_their_own_vectors():
    """Single precision cannot tell these apart; the sub-solves do."""
    values = [3.0, 1.0, 1 - 2e-8, 1 - 4e-8, 0.1]
    a = symmetric(values, 7)
    got, x = whitening.eigen(a)
    t = x.T.astype(np.longdouble) @ a @ x
    off = float(np.abs(t - np.diag(np.diag(t))).max())
    assert off < 1e-15
    _, rough = np.linalg.eigh(a.astype(np.float32))
    t = rough.T.astype(np.float64) @ a @ rough
    assert np.abs(t - np.diag(np.diag(t))).max() > 1e-9


def test_deviations_beyond_a_long(spark, monkeypatch):
    rows = [(i, [float(i) * 1024]) for i in range(4000)]
    got = {r.vec_id: r.deviation for r in found(spark, rows, scale=8)}
    kept = [(i, i * 1024 * 8) for i in range(4000)]
    s = sum(x for _, x in kept)
    for i, x in kept:
        d = (4000 * x - s) ** 2
        assert got[i] == (d if d < 2**62 else None)
