"""Durations, running totals and sums of parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .series import MAX_ROWS, running_total
from .windows import with_gaps

HOUR_MICROS = 3_600_000_000
#: duration taken for the first sample of a series, in minutes
FIRST_MINUTES = 5


def with_duration_hours(
    df: DataFrame,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add the hours since the previous sample; five minutes for the first."""
    first = F.lit(FIRST_MINUTES * 60_000_000)
    return (
        with_gaps(df, keys, order, "_gap", max_rows)
        .withColumn("duration_hours", F.coalesce("_gap", first) / HOUR_MICROS)
        .drop("_gap")
    )


def running_energy(
    df: DataFrame,
    power: str,
    hours: str = "duration_hours",
    name: str = "throughput_kwh",
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add the energy moved in either direction from the start of the series."""
    moved = df.withColumn("_moved", F.abs(F.col(power) * F.col(hours)))
    return running_total(moved, keys, order, "_moved", name, max_rows).drop("_moved")


def parts_match_total(
    parts: list[Column], total: Column, tolerance: float = 1e-4
) -> Column:
    """Whether the parts add up to the total."""
    return F.abs(sum(parts, F.lit(0.0)) - total) <= tolerance
