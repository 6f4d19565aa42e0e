"""Row-based windows over device series, safe for series of any length.

A window partitioned by device puts a whole device into one task.  That is
what we want while devices are small; a device holding a large part of the
table has to be cut along time.  `over_series` measures first: if no series has
more than `max_rows` rows it uses the plain window.  Otherwise the long series
are cut into chunks of about `max_rows` rows, each row is copied to the chunks
that need it as context, and the window is partitioned by series *and* chunk.
Results are the same in both forms; only context rows are duplicated, and they
are dropped after the window.

Which rows a chunk needs is worked out on row counts per time slot, a table
that grows with the covered time span and not with the rows, so the rows
themselves move once, in the shuffle of the window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# A group of this many rows sorts and buffers within one task's memory, in each of the
# windows that stand on one another in a task.
MAX_ROWS = 500_000

_SLOT_MICROS = 3_600_000_000  # first width tried for the slots: one hour
_SLOT_REFINEMENT = 64

_SLOT = "_slot"
_CHUNK = "_chunk"
_OWN = "_own_chunk"
_START = "_chunk_start"
_TOTAL = "_series_rows"


def micros(time_col: str | Column) -> Column:
    """Microseconds since the epoch, of either timestamp type (UTC session)."""
    col = F.col(time_col) if isinstance(time_col, str) else time_col
    return F.unix_micros(col.cast("timestamp"))


def _slot_of(time_col: str, width: int) -> Column:
    return F.floor(micros(time_col) / F.lit(width)).alias(_SLOT)


def _series(keys: Sequence[str]) -> list[Column]:
    """Partition expressions; a constant stands for 'all rows are one series'."""
    return [F.col(k) for k in keys] if keys else [F.lit(0)]


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys of which nulls are equal; the keys of `left` stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def hot_series(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS):
    """Series with more than `max_rows` rows, and their row counts.

    There are at most count(df) / max_rows of them.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(_TOTAL))
        .where(F.col(_TOTAL) > max_rows)
    )


def slot_chunks(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    hot: DataFrame,
    back: int,
    ahead: int,
    max_rows: int,
) -> tuple[DataFrame, int]:
    """Chunks of each time slot of the hot series, and the slot width.

    One row per series and slot: the chunk that owns the slot, the range of
    chunks that need its rows, and the position at which the owning chunk
    starts.  Slots are narrowed until none is larger than a chunk.
    """
    rows = df.select(*keys, time_col)
    rows = match_keys(rows, hot.select(*keys), keys, "left_semi") if keys else rows
    width = _SLOT_MICROS
    while True:
        counts = rows.groupBy(*keys, _slot_of(time_col, width)).agg(
            F.count(F.lit(1)).alias("n")
        )
        slots = stage(counts, "slots")
        biggest = slots.agg(F.max("n")).first()[0] or 0
        if biggest <= max_rows or width == 1:
            break
        width = max(1, width // _SLOT_REFINEMENT)

    in_order = (
        Window.partitionBy(*_series(keys))
        .orderBy(_SLOT)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    whole = Window.partitionBy(*_series(keys))
    chunk_rows = F.lit(max_rows)
    chunks = (
        slots.withColumn("end", F.sum("n").over(in_order))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn(_TOTAL, F.sum("n").over(whole))
        .withColumn("widest", F.max("n").over(whole))
        .withColumn(_OWN, F.floor(F.col("start") / chunk_rows))
        # first row of a chunk is at or after chunk * max_rows, so rows within
        # `back` of that position are context of the chunk
        .withColumn(
            "last",
            F.floor((F.col("end") + F.lit(back - 1)) / chunk_rows)
            if back
            else F.col(_OWN),
        )
        # last row of a chunk is before (chunk + 1) * max_rows + widest
        .withColumn(
            "first",
            F.greatest(
                F.lit(0).cast("long"),
                F.floor((F.col("start") - F.lit(ahead) - F.col("widest")) / chunk_rows),
            )
            if ahead
            else F.col(_OWN),
        )
        .withColumn("last", F.least("last", F.max(_OWN).over(whole)))
    )
    chunks = chunks.withColumn(
        _START,
        F.min("start").over(Window.partitionBy(*_series(keys), _OWN)),
    )
    return (
        chunks.select(*keys, _SLOT, _OWN, "first", "last", _START, _TOTAL),
        width,
    )


def _cut(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    back: int,
    ahead: int,
    max_rows: int,
    longest: int | None = None,
) -> DataFrame | None:
    """Rows with their chunk, or None where no series is long.

    `longest`: rows of the longest series, where the caller has counted them.
    """
    if longest is not None and longest <= max_rows:
        return None
    hot = hot_series(df, keys, max_rows).persist()
    try:
        if hot.isEmpty():
            return None
        chunks, width = slot_chunks(df, keys, time_col, hot, back, ahead, max_rows)
    finally:
        hot.unpersist()
    # No broadcast hint: Spark compares the size of `chunks` with its threshold
    # and joins by shuffle where the table is large.
    slotted = df.withColumn(_SLOT, _slot_of(time_col, width))
    rows = match_keys(slotted, chunks, [*keys, _SLOT], "left")
    zero = F.lit(0).cast("long")
    rows = rows.withColumn(_OWN, F.coalesce(_OWN, zero))
    if back or ahead:
        needed = F.sequence(F.coalesce("first", zero), F.coalesce("last", zero))
        rows = rows.withColumn(_CHUNK, F.explode(needed))
    else:
        rows = rows.withColumn(_CHUNK, F.col(_OWN))
    return rows.drop(_SLOT, "first", "last")


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    add: Callable[[DataFrame, list[Column]], DataFrame],
    back: int = 0,
    ahead: int = 0,
    max_rows: int = MAX_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Apply `add(rows, parts)`; windows partitioned by `parts` hold one series.

    `order[0]` is the time column, the others break ties.  What `add` computes
    for a row may depend on at most `back` rows before and `ahead` after it,
    and it must keep every row.
    """
    rows = _cut(df, keys, order[0], back, ahead, max_rows, longest)
    if rows is None:
        return add(df, _series(keys))
    return (
        add(rows, [*_series(keys), F.col(_CHUNK)])
        .where(F.col(_CHUNK) == F.col(_OWN))
        .drop(_CHUNK, _OWN, _START, _TOTAL)
    )


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: str = "position",
    total: str = "series_rows",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add the 0-based position of a row in its series and the series' length."""
    rows = _cut(df, keys, order[0], 0, 0, max_rows)
    if rows is None:
        ordered = Window.partitionBy(*_series(keys)).orderBy(*order)
        whole = Window.partitionBy(*_series(keys))
        return df.withColumn(
            position, (F.row_number().over(ordered) - 1).cast("long")
        ).withColumn(total, F.count(F.lit(1)).over(whole))
    window = Window.partitionBy(*_series(keys), _CHUNK)
    here = F.row_number().over(window.orderBy(*order)) - 1
    return (
        rows.withColumn(position, (F.coalesce(_START, F.lit(0)) + here).cast("long"))
        .withColumn(
            total, F.coalesce(F.col(_TOTAL), F.count(F.lit(1)).over(window))
        )
        .drop(_CHUNK, _OWN, _START, _TOTAL)
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add the sum of `value` from the start of the series up to the row."""
    rows = _cut(df, keys, order[0], 0, 0, max_rows)
    if rows is None:
        window = Window.partitionBy(*_series(keys)).orderBy(*order)
        return df.withColumn(
            name, F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
        )
    before = (
        rows.groupBy(*keys, _CHUNK)
        .agg(F.sum(value).alias("_in_chunk"))
        .withColumn(
            "_before",
            F.sum("_in_chunk").over(
                Window.partitionBy(*_series(keys))
                .orderBy(_CHUNK)
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_in_chunk")
    )
    window = Window.partitionBy(*_series(keys), _CHUNK).orderBy(*order)
    inside = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
    total = F.coalesce("_before", F.lit(0.0)) + F.coalesce(inside, F.lit(0.0))
    return (
        match_keys(rows, before, [*keys, _CHUNK], "left")
        .withColumn(
            name, F.when(inside.isNotNull() | F.col("_before").isNotNull(), total)
        )
        .drop(_CHUNK, _OWN, _START, _TOTAL, "_before")
    )
