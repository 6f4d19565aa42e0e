"""Embeddings whitened along the principal axes of their covariance.

The covariance is summed in parallel over each distinct vector once.  Its eigenvectors are
first found in single precision.  Iterations of matrix products in extended precision then
bring them to full accuracy: from the defects of orthogonality and of diagonal form follows a
correction of all vectors at once, and the error is squared each time.  Vectors whose
eigenvalues lie too close together for that are told apart by an eigenproblem of their own
span, shifted by their mean eigenvalue, where small differences are large again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_arrow
from .grids import extent, filled, matrix, whole_vectors

#: rows multiplied at once
STEP = 4096
#: iterations at most; the error is squared by each
ROUNDS = 12
#: corrections below this size: vectors are right but for clusters
CLOSE = 1e-4
#: eigenvalues below this share of the trace count as zero
NOTHING = 1e-13


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Positions of values that are linked by steps of `gap` at most, two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def _correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """First-order correction e of eigenvectors x (x becomes x + x e), eigenvalues, and the gap
    up to which eigenvalues are too close for it."""
    r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    # symmetric to the last bit: what rounding leaves then turns close vectors, but keeps them orthogonal
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    gap = 2 * (norm(off) + norm(a) * norm(r))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return e, values, gap


def _split(a: np.ndarray, x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The vectors of a cluster, turned within their span to its own eigenvectors."""
    span = x[:, members]
    # one step towards an orthonormal basis; the iterations do the rest
    span = span @ (1.5 * np.eye(len(members), dtype=x.dtype) - 0.5 * (span.T @ span))
    inner = span.T @ (a @ span)
    shift = np.trace(inner) / len(members)
    inner = inner - shift * np.eye(len(members), dtype=x.dtype)
    size = float(np.abs(inner).max())
    if size <= float(np.finfo(np.float64).eps) * abs(float(shift)):
        # equal eigenvalues: every basis of the span is right
        return span
    scaled = (inner / size).astype(np.float64)
    _, turn = np.linalg.eigh((scaled + scaled.T).astype(np.float32) / 2)
    turn = turn.astype(x.dtype)
    # the turn itself is refined as an eigenproblem of its own, so that a cluster within it is split too
    return span @ refined(inner / size, turn)


def refined(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Eigenvectors of the symmetric `a`, in its precision, from the rough ones `x`."""
    tiny = 4 * float(np.finfo(np.float64).eps) ** 1.1
    whole = x.shape[1]
    size = float(np.abs(a).max())
    was = np.inf
    for _ in range(rounds):
        e, values, gap = _correction(a, x)
        x = x + x @ e
        now = float(np.abs(e).max())
        if now > CLOSE:
            continue
        turned = False
        for members in _clusters(values.astype(np.float64), gap):
            inner = x[:, members].T @ (a @ x[:, members])
            left = float(np.abs(inner - np.diag(np.diag(inner))).max())
            if len(members) < whole and left > tiny * size:
                x[:, members] = _split(a, x, members)
                turned = True
        # at the precision of `a` corrections of close vectors no longer shrink
        if not turned and (now <= tiny or now >= was / 2):
            break
        was = np.inf if turned else now
    return x


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns.

    The greatest component of each vector is positive.
    """
    d = len(v)
    size = float(np.abs(v).max()) if d else 0.0
    if not size:
        return np.zeros(d), np.eye(d)
    a = (v / size).astype(np.longdouble)
    _, rough = np.linalg.eigh(a.astype(np.float32))
    x = refined(a, rough.astype(np.longdouble))
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order].astype(np.float64)
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    return np.maximum((values[order] * size).astype(np.float64), 0), x * signs


def _sums(rows: DataFrame, width: int, per_batch) -> list[float]:
    """Sums over all batches of a flat array of doubles that `per_batch` gives for each.

    Each task sums its own; the tasks' sums are added by position on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column("x"), width)
            for i in range(0, len(x), STEP):
                part = per_batch(x[i : i + STEP])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    parts = map_arrow(rows.select("x"), run, "s array<double>")
    summed = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return [r.v for r in sorted(summed.collect())]


def covariance(distinct: DataFrame, width: int, n: int) -> tuple[np.ndarray, list[int]]:
    """Covariance of staged vectors (divisor n) and the sum of each dimension.

    Vectors are moved by the whole number nearest to the mean before they are multiplied.  All sums are whole
    numbers then, and exact up to 2^53; what is left of the mean is below a half and taken off exactly.
    """
    sums = [int(s) for s in _sums(distinct, width, lambda x: x.sum(axis=0).astype(np.float64))]
    near = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(near, np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        z = (x - centre).astype(np.float64)
        return (z.T @ z).ravel()

    flat = [int(p) for p in _sums(distinct, width, products)]
    rest = [s - n * m for s, m in zip(sums, near, strict=True)]
    v = [
        [(n * flat[i * width + j] - rest[i] * rest[j]) / (n * n) for j in range(width)]
        for i in range(width)
    ]
    return np.array(v, np.float64), sums


def whiten(
    vectors: DataFrame,
    components: int = 4,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(`id_col`, component, n, deviation, whitened, explained, identity_error) of every vector.

    Covariances and means are those of the n distinct vectors, in whole numbers floor(scale * x).  deviation
    is the sum of squares of n * x - sums, null where that exceeds a long.  explained is the component's
    share of the variance; identity_error the greatest entry, without sign, of the
    covariance of the whitened vectors less the identity, measured on the vectors.  A component
    without variance has explained 0 and whitened null, and no part in identity_error (0 without
    any other).  Rows without vector or with a null or non-finite component are left out; rows with a
    null or repeated id are rows as others; shorter vectors are filled up with zeros.  Other
    columns are not looked at; an empty table gives no rows.
    """
    rows = stage(whole_vectors(vectors, scale, vector_col, id=id_col), "whiten-vectors")
    width, _ = extent(rows)
    rows = rows.withColumn("x", filled(F.col("x"), width))
    distinct = stage(rows.select("x").distinct(), "whiten-distinct")
    n = distinct.count()
    schema = rows.select(F.col("id").alias(id_col)).schema
    for name, kind in [
        ("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double"),
    ]:
        schema = schema.add(name, kind)
    if not n or not width:
        return rows.sparkSession.createDataFrame([], schema)
    v, sums = covariance(distinct, width, n)
    values, axes = eigen(v)
    trace = float(np.trace(v))
    kept = min(components, width)
    some = [k for k in range(kept) if values[k] > NOTHING * trace]
    mean = np.array([s / n for s in sums])
    onto = np.zeros((width, kept))
    for k in some:
        onto[:, k] = axes[:, k] / np.sqrt(values[k])

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ onto
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    facts = np.array(_sums(distinct, width, spread))
    off = facts[:kept] / n
    spread_of = facts[kept:].reshape(kept, kept) / n - np.outer(off, off)
    identity_error = float(np.abs((spread_of - np.eye(kept))[np.ix_(some, some)]).max()) if some else 0.0
    total = np.array(sums, np.int64)
    exact = all(abs(s) < 1 << 62 for s in sums) and n < 1 << 36

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            rough = ((n * x.astype(np.float64) - total) ** 2).sum(axis=1)
            y = n * x - total
            deviation = pa.array((y * y).sum(axis=1), mask=(rough >= 2.0**62) | (not exact))
            w = (x - mean) @ onto
            for k in range(kept):
                m = len(x)
                none = np.full(m, k not in some)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(np.full(m, k + 1, np.int32)), pa.array(np.full(m, n)),
                        deviation, pa.array(w[:, k], mask=none),
                        pa.array(np.full(m, values[k] / trace if k in some else 0.0)),
                        pa.array(np.full(m, identity_error)),
                    ],
                    schema.names,
                )

    return map_arrow(rows.select("id", "x"), run, schema)
