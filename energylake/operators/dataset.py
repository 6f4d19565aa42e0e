"""Targets, chronological splits, sequences and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..session import stage
from .series import MAX_ROWS, over_series, with_positions
from .windows import (
    by_interval_class,
    first_interval_minutes,
    horizon_samples,
    lead_column,
    series_facts,
)


def horizon_rows(
    df: DataFrame,
    horizon_hours: int,
    keys: Sequence[str] = tuple(schemas.SERIES),
    time_col: str = "time",
) -> int:
    """Rows between a sample and its target, from the distance of the first two.

    One distance for all series; `lead_by_class` takes each series' own.
    """
    return horizon_samples(horizon_hours, first_interval_minutes(df, keys, time_col))


def lead_target(
    df: DataFrame,
    target: str,
    rows_ahead: int,
    features: Sequence[str] = (),
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Add `label`, the target `rows_ahead` later; rows without it or a feature are left out."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    labelled = lead_column(
        df, target, rows_ahead, "label", keys, order, max_rows, longest
    )
    return labelled.dropna(subset=["label", *features])


def lead_by_class(
    df: DataFrame,
    target: str,
    horizon_hours: int,
    features: Sequence[str] = (),
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """`lead_target` with the horizon in rows of each series' own interval class."""
    facts = stage(series_facts(df, keys, order, max_rows), "facts")

    def add(rows: DataFrame, minutes: int, longest: int) -> DataFrame:
        ahead = horizon_samples(horizon_hours, minutes)
        return lead_target(rows, target, ahead, features, keys, order, max_rows, longest)

    return by_interval_class(df, facts, keys, add)


def _cut(position: str, rows: Column, share: float) -> Column:
    return F.col(position) < F.floor(rows.cast("double") * F.lit(share))


def chrono_split(
    df: DataFrame,
    test_size: float,
    validation_split: float | None = None,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add `split`: the first rows of each series train, the last ones test.

    With `validation_split` the end of the training part becomes 'validation'.
    `keys=[]` splits all rows together by time.
    """
    placed = with_positions(df, keys, order, "_position", "_rows", max_rows)
    train_rows = F.floor(F.col("_rows").cast("double") * F.lit(1 - test_size))
    split = F.when(F.col("_position") >= train_rows, "test")
    if validation_split is not None:
        split = split.when(
            ~_cut("_position", train_rows, 1 - validation_split), "validation"
        )
    return placed.withColumn("split", split.otherwise("train")).drop(
        "_position", "_rows"
    )


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("samples"))


def sequences(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    length: int,
    rows_ahead: int,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    stride: int = 1,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Every run of `length` rows with the target `rows_ahead` after its end.

    One row per run: the series, the `order` columns of the run's last row, the run `x` as an
    array of feature rows, and `y`.  The row of the target looks back on its
    run, so only earlier rows are context.  Runs without target are left out;
    `stride` keeps every stride-th run of a series.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    kept = [k for k in keys if k not in order]

    def add(rows: DataFrame, parts: list[Column]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*order)
        run = w.rowsBetween(-(length - 1 + rows_ahead), -rows_ahead)
        return rows.withColumns(
            {
                "x": F.collect_list(F.array(*features)).over(run),
                **{
                    f"_end{i}": F.lag(c, rows_ahead).over(w) if rows_ahead else F.col(c)
                    for i, c in enumerate(order)
                },
                "y": F.col(target).cast("double"),
            }
        )

    if stride > 1:
        df = with_positions(df, keys, order, "_position", "_rows", max_rows)
    runs = over_series(
        df, keys, order, add, back=length - 1 + rows_ahead, max_rows=max_rows
    ).where(
        (F.size("x") == length) & F.col("y").isNotNull() & ~F.isnan("y")
    )
    if stride > 1:
        first = length - 1 + rows_ahead
        runs = runs.where((F.col("_position") - first) % stride == 0)
    ends = [F.col(f"_end{i}").alias(c) for i, c in enumerate(order)]
    return runs.select(*kept, *ends, "x", "y")


def padded_sequences(
    df: DataFrame,
    features: Sequence[str],
    length: int,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Sequences to predict from: all full runs of a series.

    A series shorter than `length` gives one sequence, filled with rows of zeros
    at its start.
    """
    kept = [k for k in keys if k not in order]

    def add(rows: DataFrame, parts: list[Column]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*order)
        return rows.withColumns(
            {
                "x": F.collect_list(F.array(*features)).over(
                    w.rowsBetween(-(length - 1), 0)
                ),
                "_last": F.lead(F.lit(1)).over(w).isNull(),
            }
        )

    zeros = F.array(*[F.lit(0.0) for _ in features])
    rows = over_series(
        df, keys, order, add, back=length - 1, ahead=1, max_rows=max_rows
    ).where((F.size("x") == length) | F.col("_last"))
    return rows.select(
        *kept,
        *order,
        F.concat(F.array_repeat(zeros, F.lit(length) - F.size("x")), "x").alias("x"),
    )


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations; a constant column is only centred."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Scaler:
        stats = df.agg(
            *[F.avg(c).alias(f"mean{i}") for i, c in enumerate(features)],
            *[F.stddev_pop(c).alias(f"std{i}") for i, c in enumerate(features)],
        ).first()
        return cls(
            {c: stats[f"mean{i}"] or 0.0 for i, c in enumerate(features)},
            {c: stats[f"std{i}"] or 1.0 for i, c in enumerate(features)},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - self.mean[c]) / self.std[c] for c in self.mean}
        )
