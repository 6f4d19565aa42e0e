"""Vectors as whole numbers, for the operators that work on a grid of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: products of two components of this size, summed over a vector, stay below 2^63
LARGEST = 1 << 26


def whole_vectors(
    vectors: DataFrame, scale: int, vector_col: str, **columns: str
) -> DataFrame:
    """The named columns and `x`: floor(scale * component) as longs.

    Rows whose vector is null or holds a null or non-finite component are left out.
    """
    v = F.col(vector_col)
    bad = F.exists(
        v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    )
    whole: Column = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.filter(v.isNotNull()).filter(~bad).select(
        *[F.col(old).alias(new) for new, old in columns.items()], whole.alias("x")
    )


def extent(rows: DataFrame) -> tuple[int, int]:
    """Length of the longest vector (0 without rows) and the number of rows."""
    facts = rows.agg(
        F.max(F.size("x")), F.count(F.lit(1)),
        F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))),
    ).first()
    if (facts[2] or 0) > LARGEST:
        raise ValueError(f"components may be {LARGEST} at most after scaling, found {facts[2]}")
    return facts[0] or 0, facts[1]


def filled(x: Column, width: int) -> Column:
    """Shorter vectors, filled up with zeros."""
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row per vector; shorter ones are filled up with zeros."""
    starts = column.offsets.to_numpy()
    values = column.values.to_numpy()
    if (np.diff(starts) == width).all():
        return values[starts[0] : starts[-1]].reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for row, a, b in zip(out, starts, starts[1:], strict=False):
        row[: b - a] = values[a:b]
    return out
