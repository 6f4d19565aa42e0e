"""Windows, lags and leads counted in each series' own sampling interval, in one plan.

The interval of a series is the exact median of its gaps.  From it follow numbers of rows, which
stand in a column: a day of a device that samples every 10 seconds is 8640 rows, one
of a 45-minute meter is 32, and both go through the same windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..session import stage
from .series import MAX_ROWS, match_keys, over_series
from .windows import (
    DEFAULT_SAMPLES_PER_DAY,
    DEFAULT_SAMPLES_PER_HOUR,
    Names,
    with_gaps,
)

HOUR = 3_600_000_000  # microseconds
#: widths of the ranges among which a middle value is looked for; the last one is a value
RANGES = (1 << 32, 1 << 16, 1)
#: a distance of rows on the scale on which windows look for one row
UNIT = 1_000_000_000


# --- the interval of every series --------------------------------------------


def median_per_series(
    values: DataFrame, keys: Sequence[str], col: str, name: str = "median"
) -> DataFrame:
    """Exact median of a column of whole numbers for every series; series without any are left out.

    Values are counted per range of 2^32, then the ranges that hold the two middle ranks by ranges of
    2^16, then those value by value.  So no task holds more than 2^16 counts of a series and rank (or
    as many as there are ranges of 2^32), however many different values there are.
    """
    counted = stage(
        values.where(F.col(col).isNotNull())
        .groupBy(*keys, F.col(col).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n")),
        "gap-counts",
    )
    whole = Window.partitionBy(*keys)
    middle = None
    for width in RANGES:
        place = F.floor(F.col("_v") / F.lit(width)).cast("long")
        if middle is None:
            ranges = counted.groupBy(*keys, place.alias("_r")).agg(F.sum("_n").alias("_n"))
            total = F.sum("_n").over(whole)
            ranks = F.array(F.floor((total - 1) / 2), F.floor(total / 2))
            ranges = ranges.withColumn("_ranks", ranks).select(
                "*", F.posexplode("_ranks").alias("_side", "_rank")
            )
        else:
            near = counted.withColumn("_in", F.floor(F.col("_v") / F.lit(before)).cast("long"))
            near = match_keys(near, middle.withColumnRenamed("_r", "_in"), [*keys, "_in"], "inner")
            ranges = near.groupBy(*keys, "_side", "_rank", place.alias("_r")).agg(
                F.sum("_n").alias("_n")
            )
        upto = (
            Window.partitionBy(*keys, "_side")
            .orderBy("_r")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        end = F.sum("_n").over(upto)
        middle = (
            ranges.withColumn("_end", end)
            .withColumn("_start", F.col("_end") - F.col("_n"))
            .where((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_end")))
            .select(*keys, "_side", (F.col("_rank") - F.col("_start")).alias("_rank"), "_r")
        )
        before = width
    return middle.groupBy(*keys).agg((F.sum("_r") / 2).alias(name))


def series_intervals(
    df: DataFrame,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Rows and exact median interval (`interval_micros`, null for a single row) of every series."""
    gaps = stage(
        with_gaps(df.select(*dict.fromkeys([*keys, *order])), keys, order, max_rows=max_rows)
        .select(*keys, "gap_micros"),
        "gaps",
    )
    rows = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("series_rows"))
    medians = median_per_series(gaps, keys, "gap_micros", "interval_micros")
    return match_keys(rows, medians, keys, "left")


def day_rows(days: int, micros: Column | str = "interval_micros") -> Column:
    """Rows of so many days, one at least; halves are rounded to even."""
    micros = F.col(micros) if isinstance(micros, str) else micros
    a_day = F.when(micros > 0, F.bround(24 * HOUR / micros)).otherwise(DEFAULT_SAMPLES_PER_DAY)
    return F.greatest(F.lit(1), a_day * days).cast("long")


def hour_rows(micros: Column | str = "interval_micros") -> Column:
    """Rows of an hour; 0 where the interval is two hours or more."""
    micros = F.col(micros) if isinstance(micros, str) else micros
    an_hour = F.when(micros > 0, F.bround(HOUR / micros)).otherwise(DEFAULT_SAMPLES_PER_HOUR)
    return an_hour.cast("long")


def horizon_rows(hours: int, micros: Column | str = "interval_micros") -> Column:
    """Rows between a sample and the one `hours` later; never the sample itself."""
    micros = F.col(micros) if isinstance(micros, str) else micros
    ahead = F.when(micros > 0, F.greatest(F.lit(1), F.bround(hours * HOUR / micros)))
    return ahead.otherwise(hours * DEFAULT_SAMPLES_PER_HOUR).cast("long")


def with_row_counts(
    df: DataFrame, facts: DataFrame, keys: Sequence[str], **counts: Column
) -> tuple[DataFrame, dict[str, int], int]:
    """`df` with numbers of rows that follow from its series' facts, as columns.

    Also the greatest of each, and the rows of the longest series: one row reaches the driver.
    """
    numbers = stage(
        facts.select(*keys, "series_rows", *[c.alias(n) for n, c in counts.items()]), "row-counts"
    )
    most = numbers.agg(F.max("series_rows"), *[F.max(n) for n in counts]).first()
    greatest = {n: int(most[i + 1] or 0) for i, n in enumerate(counts)}
    return match_keys(df, numbers.drop("series_rows"), keys, "inner"), greatest, int(most[0] or 0)


# --- windows whose length is a column ------------------------------------------


def _at(parts: list[Column], row: str, distance: Column, sign: int):
    """The window of the one row `distance` rows before (`sign` -1) or after (1).

    Rows are ordered by their number divided by the distance; on that scale the row looked for is exactly
    one unit away, whatever the distance, so one frame serves all series.
    """
    scaled = F.col(row) / F.greatest(F.lit(1), distance) * F.lit(float(UNIT))
    frame = sorted((sign * (UNIT - 1), sign * (UNIT + 1)))
    return Window.partitionBy(*parts).orderBy(scaled).rangeBetween(*frame)


def rolling_mean_std(
    df: DataFrame,
    columns: Names,
    length: str,
    widest: int,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Mean and sample deviation of the last `length` rows, null unless all have a value.

    `length` names a column that is the same in all rows of a series, `widest` is its greatest value.
    A window is the end of one block of that many rows and the start of the next; counts, means and squared
    deviations grow from both ends of each block and are merged, so the cost of a row does not
    depend on the length, and nothing is subtracted from a running sum.
    """
    n = F.col(length)

    def add(rows: DataFrame, parts: list[Column]) -> DataFrame:
        kept = rows.columns
        line = Window.partitionBy(*parts).orderBy(*order)
        rows = rows.withColumn("_row", F.row_number().over(line)).withColumn(
            "_block", F.floor((F.col("_row") - 1) / n)
        )
        block = Window.partitionBy(*parts, "_block")
        grows = (Window.unboundedPreceding, 0)
        sides = {
            "e": block.orderBy(F.desc("_row")).rowsBetween(*grows),
            "s": block.orderBy("_row").rowsBetween(*grows),
        }
        for side, frame in sides.items():
            made = {}
            for i, metric in enumerate(columns):
                made[f"_{side}n{i}"] = F.count(metric).over(frame)
                made[f"_{side}avg{i}"] = F.avg(metric).over(frame)
                made[f"_{side}sq{i}"] = F.var_pop(metric).over(frame) * F.count(metric).over(frame)
            rows = rows.withColumns(made)
        first = _at(parts, "_row", n - 1, -1)
        before = [f"_e{what}{i}" for i in range(len(columns)) for what in ("n", "avg", "sq")]
        rows = rows.withColumns({c: F.first(c).over(first) for c in before})

        whole = F.col("_row") % n == 0  # the window is one block
        out = []
        for i, (avg_name, std_name) in enumerate(columns.values()):
            n1, avg1, sq1 = (F.col(f"_e{what}{i}") for what in ("n", "avg", "sq"))
            n2, avg2, sq2 = (F.col(f"_s{what}{i}") for what in ("n", "avg", "sq"))
            apart = avg2 - avg1
            mean = F.when(whole, avg2).otherwise(avg1 + apart * n2 / n)
            square = F.when(whole, sq2).otherwise(sq1 + sq2 + apart * apart * (n1 * n2 / n))
            full = F.when(whole, n2).otherwise(n1 + n2) == n
            out.append(F.when(full, mean).alias(avg_name))
            deviation = F.sqrt(square / F.greatest(F.lit(1), n - 1))
            out.append(F.when(full & (n > 1), deviation).alias(std_name))
        return rows.select(*[F.col(f"`{c}`") for c in kept], *out)

    return over_series(
        df, keys, order, add, back=max(0, widest - 1), max_rows=max_rows, longest=longest
    )


def _shifted(
    df: DataFrame,
    columns: dict[str, tuple[str, str]],
    sign: int,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int,
    longest: int | None,
    widest: int,
) -> DataFrame:
    def add(rows: DataFrame, parts: list[Column]) -> DataFrame:
        line = Window.partitionBy(*parts).orderBy(*order)
        rows = rows.withColumn("_row", F.row_number().over(line))
        added = {
            name: F.when(F.col(k) > 0, F.first(metric).over(_at(parts, "_row", F.col(k), sign)))
            for name, (metric, k) in columns.items()
        }
        return rows.withColumns(added).drop("_row")

    context = {"back": widest} if sign < 0 else {"ahead": widest}
    return over_series(df, keys, order, add, **context, max_rows=max_rows, longest=longest)


def lag_columns(
    df: DataFrame,
    lags: dict[str, tuple[str, str]],
    widest: int,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Add earlier values: `lags` maps a new column to (metric, column of rows back).

    The rows back are the same in all rows of a series, `widest` at most; null where they are 0.
    """
    return _shifted(df, lags, -1, keys, order, max_rows, longest, widest)


def lead_column(
    df: DataFrame,
    metric: str,
    rows_ahead: str,
    widest: int,
    name: str = "target",
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Add the value as many rows later as the column `rows_ahead` says, `widest` at most."""
    return _shifted(df, {name: (metric, rows_ahead)}, 1, keys, order, max_rows, longest, widest)


def lead_by_interval(
    df: DataFrame,
    target: str,
    horizon_hours: int,
    features: Sequence[str] = (),
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
    name: str = "label",
) -> DataFrame:
    """Add `name`, the target `horizon_hours` later by each series' own interval.

    Rows without it or without a feature are left out.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    facts = series_intervals(df, keys, order, max_rows)
    rows, widest, longest = with_row_counts(df, facts, keys, _ahead=horizon_rows(horizon_hours))
    labelled = lead_column(
        rows, target, "_ahead", widest["_ahead"], name, keys, order, max_rows, longest
    )
    return labelled.drop("_ahead").dropna(subset=[name, *features])
