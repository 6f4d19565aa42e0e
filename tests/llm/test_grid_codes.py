"""Codes of vector parts against measuring every part against every entry."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from energylake.llm import grid_codes
from energylake.llm.grids import whole_vectors


def plain(rows, parts, entries, rounds=2):
    """Rows (id, vector, label) to {(id, code, error, label error): times} and the digest."""
    kept = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    least = {}
    for i, v, _ in kept:
        least[i] = min(least.get(i, v), v)
    ids = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    books = [[least[i][p * width : (p + 1) * width] for i in ids] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        found = [[nearest(v[p], books[p])[1] for v in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(ids)):
                mine = [v[p] for v, n in zip(cut, found[p], strict=True) if n == e]
                if mine:
                    books[p][e] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    out = []
    for (i, _, label), v in zip(kept, cut, strict=True):
        best = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best)))
    of = {}
    for _, label, _, error in out:
        of[label] = of.get(label, 0) + error
    joined = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(joined.encode()).hexdigest()
    return sorted(((i, c, e, of[label], digest) for i, label, c, e in out), key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumn("id", F.lit("z")).withColumn("x", F.lit(1)).withColumn("n", F.lit(None)).withColumn("code", F.lit(0))
    return sorted(map(tuple, grid_codes.compress(df.repartition(3), **options).collect()), key=str)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (7, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % 7] + rng.normal(0, 0.05, dim)], i % 3 or None) for i in range(n)]


@pytest.mark.parametrize(("dim", "parts", "entries"), [(8, 4, 5), (6, 6, 16), (12, 3, 64)])
def test_all_parts(spark, dim, parts, entries):
    rows = vectors(150, dim, dim)
    assert found(spark, rows, parts=parts, entries=entries) == plain(rows, parts, entries)


def test_odd_rows(spark):
    rows = [
        (None, [0.5, 0.25, -1.0, 2.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan")], None),
        (6, [float("-inf"), 1.0], 2), (1, [0.1, 0.2, 0.3, 0.4], None), (1, [0.1, 0.2, 0.3, 0.4], None),
        (1, [0.1, 0.2, 0.1, 0.4], 7), (8, [], 7), (9, [1.0, -0.001], 1), (None, [0.5, 0.25, -1.0, 2.5], 1),
        (10, [0.1, 0.2, 0.3, 0.4, 0.9], 1),
    ]
    assert found(spark, rows, parts=2, entries=4) == plain(rows, 2, 4)


def test_ties_go_to_the_lower_entry(spark):
    same = [(i, [0.0, 1.0], 0) for i in range(6)] + [(6 + i, [1.0, 0.0], 0) for i in range(6)]
    got = found(spark, same, parts=2, entries=12)
    assert got == plain(same, 2, 12)
    assert {c for _, c, *_ in got} == {"0000", "0606"}


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == []


def test_only_empty_vectors(spark):
    assert [r[:4] for r in found(spark, [(1, [], 1), (2, [], None)], parts=2)] == [(1, "0000", 0, 0), (2, "0000", 0, 0)]


def test_components_that_would_overflow(spark):
    with pytest.raises(ValueError, match="components"):
        found(spark, [(1, [1e30], 1)])


@pytest.mark.parametrize("memory", [1, 40, 1 << 15])
def test_memory_of_boxes(memory):
    """Whatever is remembered, the answers are those of a full search, with far fewer distances."""
    rng = np.random.default_rng(3)
    book = rng.integers(-90, 90, (64, 4))
    parts = rng.integers(-120, 120, (3000, 4))
    cells = grid_codes.CellMemory(book, memory)
    for some in np.split(parts, 5):
        entry, squared = cells.nearest(some)
        full = ((some[:, None] - book) ** 2).sum(axis=2)
        assert (entry == full.argmin(axis=1)).all()
        assert (squared == full.min(axis=1)).all()
    assert cells.measured < len(parts) * len(book) / 2
    assert len(cells.known) <= max(memory, 600)


def test_no_box_loses_its_nearest():
    rng = random.Random(5)
    book = np.array([[rng.randint(-20, 20) for _ in range(2)] for _ in range(30)])
    cells = grid_codes.CellMemory(book)
    for box in [(0, 0), (-1, 2), (3, -3)]:
        kept = set(cells._not_dominated(np.array([box]))[0])
        for a in range(cells.edge):
            for b in range(cells.edge):
                point = np.array([box[0] * cells.edge + a, box[1] * cells.edge + b])
                d = ((point - book) ** 2).sum(axis=1)
                assert set(np.flatnonzero(d == d.min())) <= kept


def test_hot_labels(spark, monkeypatch):
    """Labels above the bound are broadcast, the others shuffled; nothing else changes."""
    from energylake.llm import common

    rows = vectors(120, 4, 9)
    want = found(spark, rows, parts=2, entries=8)
    monkeypatch.setattr(common, "ROWS_PER_KEY", 39)
    monkeypatch.setattr(common, "MOST_HOT", 4)
    assert found(spark, rows, parts=2, entries=8) == want


def test_decoding(spark):
    rows = vectors(60, 8, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = whole_vectors(df, 256, "embedding", id="vec_id").cache()
    books = grid_codes.fit(whole, 4, 8)
    coded = grid_codes.encode(whole, books)
    back = {r.id: r for r in grid_codes.decode(coded, books).collect()}
    for r in whole.collect():
        assert sum((a - b) ** 2 for a, b in zip(r.x, back[r.id].vector, strict=True)) == back[r.id].error
