"""Rolling, lag and lead features and sampling intervals of device series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..session import new_path, stage
from .series import MAX_ROWS, match_keys, micros, over_series

# The sampling interval assumed where the data show none.
DEFAULT_SAMPLES_PER_DAY = 288
DEFAULT_SAMPLES_PER_HOUR = 12

# Up to this many rows a plain sliding frame is faster than one made of blocks.
SLIDING_FRAME_ROWS = 12


# --- sampling interval -----------------------------------------------------


def with_gaps(
    df: DataFrame,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    name: str = "gap_micros",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add the time since the previous row of the series, in microseconds."""

    def add(rows: DataFrame, parts: list[Column]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*order)
        now = micros(order[0])
        return rows.withColumn(name, now - F.lag(now).over(w))

    return over_series(df, keys, order, add, back=1, max_rows=max_rows)


def median_gap(gaps: DataFrame, col: str = "gap_micros") -> DataFrame:
    """Exact median of a column of whole numbers, as one row.

    The column is counted per value, then per range of 2^20 values to find the
    range(s) holding the two middle ranks; only these are looked at value by
    value.  So no task holds more than the ranges, or 2^20 values of each of
    two ranges, however many different gaps there are.
    """
    width = 1 << 20
    # staged, as the windows over the series would else be worked out for both uses
    values = stage(
        gaps.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("v"))
        .agg(F.count(F.lit(1)).alias("n")),
        "gaps",
    )
    ranges = values.groupBy(F.floor(F.col("v") / width).alias("r")).agg(
        F.sum("n").alias("n")
    )
    upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    ranges = (
        ranges.withColumn("end", F.sum("n").over(upto))
        .withColumn("total", F.sum("n").over(everything))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("low", F.floor((F.col("total") - 1) / 2))
        .withColumn("high", F.floor(F.col("total") / 2))
    )

    def holds(rank: str) -> Column:
        return (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("end"))

    middle = ranges.where(holds("low") | holds("high")).select(
        "r", "start", "low", "high"
    )
    # `middle` has at most two rows
    near = values.withColumn("r", F.floor(F.col("v") / width)).join(
        F.broadcast(middle), "r"
    )
    inside = Window.partitionBy("r").orderBy("v")
    near = near.withColumn(
        "end",
        F.col("start")
        + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    ).withColumn("start", F.col("end") - F.col("n"))
    return near.agg(
        (
            (
                F.max(F.when(holds("low"), F.col("v")))
                + F.max(F.when(holds("high"), F.col("v")))
            )
            / 2
        ).alias("median_micros")
    )


def median_interval_minutes(
    df: DataFrame,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
) -> float | None:
    """Median time between samples over all series; None without any gap."""
    gaps = with_gaps(
        df.select(*dict.fromkeys([*keys, *order])), keys, order, max_rows=max_rows
    )
    median = median_gap(gaps).first()[0]
    return None if median is None else median / 60e6


def first_interval_minutes(
    df: DataFrame,
    keys: Sequence[str] = tuple(schemas.SERIES),
    time_col: str = "time",
) -> float | None:
    """Time between the first two rows of the series that starts first."""
    if keys:
        first = df.orderBy(time_col, *keys).select(*keys).first()
        for key in keys if first else ():
            df = df.where(F.col(key).eqNullSafe(F.lit(first[key])))
    rows = df.select(micros(time_col).alias("t")).orderBy("t").limit(2).collect()
    return (rows[1]["t"] - rows[0]["t"]) / 60e6 if len(rows) == 2 else None


def samples_per_day(interval_minutes: float | None) -> int:
    if interval_minutes is None:
        interval_minutes = 5
    if interval_minutes <= 0:
        return DEFAULT_SAMPLES_PER_DAY
    return round(24 * 60 / interval_minutes)


def samples_per_hour(interval_minutes: float | None) -> int:
    """Rounded half to even, so an interval of two hours or more gives 0."""
    if interval_minutes is None or interval_minutes <= 0:
        return DEFAULT_SAMPLES_PER_HOUR
    return round(60 / interval_minutes)


def horizon_samples(hours: int, interval_minutes: float | None) -> int:
    """Rows between a sample and the one `hours` later; never the sample itself."""
    if interval_minutes is None or interval_minutes <= 0:
        return hours * DEFAULT_SAMPLES_PER_HOUR
    return max(1, round(hours * 60 / interval_minutes))


# Sampling intervals, in minutes, that tell one class of series from another.
INTERVAL_CLASSES = (1, 2, 5, 10, 15, 20, 30, 60, 120, 180, 240, 360, 720, 1440)
DEFAULT_INTERVAL = 5


def interval_class(minutes: Column) -> Column:
    """The class next to an interval by ratio; the default where there is none."""
    found = F.lit(INTERVAL_CLASSES[-1])
    for low, high in reversed(list(zip(INTERVAL_CLASSES, INTERVAL_CLASSES[1:]))):
        found = F.when(minutes < math.sqrt(low * high), low).otherwise(found)
    return F.when(minutes > 0, found).otherwise(DEFAULT_INTERVAL).cast("int")


def series_facts(
    df: DataFrame,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Rows, median interval and interval class of every series, in one pass.

    Intervals count in whole seconds, so that a series has a bounded number of different
    ones however long it is; the median is looked for among these, each with its number of rows.
    """
    gaps = with_gaps(
        df.select(*dict.fromkeys([*keys, *order])), keys, order, max_rows=max_rows
    )
    counted = gaps.groupBy(*keys, F.floor(F.col("gap_micros") / 1_000_000).alias("_v")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count("gap_micros").alias("_n")
    )
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns(
        {"_end": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)}
    )

    def at(rank: Column) -> Column:
        here = (F.col("_end") - F.col("_n") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    facts = ranked.groupBy(*keys).agg(
        F.sum("_rows").alias("series_rows"), ((at(low) + at(high)) / 2 / 60).alias("interval_minutes")
    )
    return facts.withColumn("interval_class", interval_class(F.col("interval_minutes")))


def by_interval_class(
    df: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    add: Callable[[DataFrame, int, int], DataFrame],
) -> DataFrame:
    """`add(rows, minutes, longest)` for the series of each interval class, united.

    `minutes` is the class, `longest` the rows of its longest series.  There are at
    most as many parts as `INTERVAL_CLASSES`.
    """
    found = (
        facts.groupBy("interval_class").agg(F.max("series_rows").alias("longest")).collect()
    )
    if not found:
        return add(df, DEFAULT_INTERVAL, 0)
    if len(found) == 1:
        return add(df, found[0]["interval_class"], found[0]["longest"])
    # written by class, so that each part reads its own rows only
    spark = df.sparkSession
    path = new_path(spark, "classes")
    classed = match_keys(df, facts.select(*keys, "interval_class"), keys, "inner")
    classed.write.partitionBy("interval_class").parquet(path)
    stored = spark.read.schema(classed.schema).parquet(path)
    parts = []
    for row in sorted(found):
        own = stored.where(F.col("interval_class") == row["interval_class"])
        parts.append(add(own.drop("interval_class"), row["interval_class"], row["longest"]))
    return reduce(DataFrame.unionByName, parts)


def rolling_rows(interval_minutes: float | None, days: int) -> int:
    return max(1, samples_per_day(interval_minutes) * days)


# --- rolling mean and deviation --------------------------------------------

Names = dict[str, tuple[str, str]]


def _sliding(
    rows: DataFrame, parts: list[Column], order: Sequence[str], columns: Names, n: int
) -> DataFrame:
    frame = Window.partitionBy(*parts).orderBy(*order).rowsBetween(-(n - 1), 0)
    added = {}
    for metric, (avg_name, std_name) in columns.items():
        full = F.count(metric).over(frame) == n
        added[avg_name] = F.when(full, F.avg(metric).over(frame))
        added[std_name] = F.when(full, F.stddev_samp(metric).over(frame))
    return rows.withColumns(added)


def _by_blocks(
    rows: DataFrame, parts: list[Column], order: Sequence[str], columns: Names, n: int
) -> DataFrame:
    """A window of `n` rows as the end of one block of n rows and the start of the next.

    Counts, means and squared deviations grow from both ends of each block and
    are merged, so the cost of a row does not depend on `n`.  Nothing is
    subtracted from a running sum: a large value leaves no residue in the
    windows after it.
    """
    kept = rows.columns
    w = Window.partitionBy(*parts).orderBy(*order)
    block = Window.partitionBy(*parts, "_block")
    grows = (Window.unboundedPreceding, 0)
    start = block.orderBy("_row").rowsBetween(*grows)
    end = block.orderBy(F.desc("_row")).rowsBetween(*grows)
    # the same order as `w`, in the form of the sort that `start` needs
    line = Window.partitionBy(*parts).orderBy("_block", "_row")

    def moments(side: str, frame) -> dict[str, Column]:
        made = {}
        for i, metric in enumerate(columns):
            count = F.count(metric).over(frame)
            made[f"_{side}n{i}"] = count
            made[f"_{side}avg{i}"] = F.avg(metric).over(frame)
            made[f"_{side}sq{i}"] = F.var_pop(metric).over(frame) * count
        return made

    rows = rows.withColumn("_row", F.row_number().over(w)).withColumn(
        "_block", F.floor((F.col("_row") - 1) / n)
    )
    rows = rows.withColumns(moments("e", end)).withColumns(moments("s", start))
    before = [f"_e{name}{i}" for i in range(len(columns)) for name in ("n", "avg", "sq")]
    rows = rows.withColumns({c: F.lag(c, n - 1).over(line) for c in before})

    one_block = F.col("_row") % n == 0
    out = []
    for i, (avg_name, std_name) in enumerate(columns.values()):
        n1, avg1, sq1 = (F.col(f"_e{name}{i}") for name in ("n", "avg", "sq"))
        n2, avg2, sq2 = (F.col(f"_s{name}{i}") for name in ("n", "avg", "sq"))
        apart = avg2 - avg1
        mean = F.when(one_block, avg2).otherwise(avg1 + apart * n2 / n)
        square = F.when(one_block, sq2).otherwise(
            sq1 + sq2 + apart * apart * (n1 * n2 / n)
        )
        full = F.when(one_block, n2).otherwise(n1 + n2) == n
        out.append(F.when(full, mean).alias(avg_name))
        out.append(F.when(full, F.sqrt(square / (n - 1))).alias(std_name))
    return rows.select(*[F.col(f"`{c}`") for c in kept], *out)


def rolling_mean_std(
    df: DataFrame,
    columns: Names,
    n: int,
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Mean and sample deviation of the last `n` rows, null unless all have a value.

    `columns` maps a metric to the names of its mean and deviation.  Values must
    not be NaN (see `functions.cleaning.nan_to_null`).
    """
    form = _sliding if n <= SLIDING_FRAME_ROWS else _by_blocks

    def add(rows: DataFrame, parts: list[Column]) -> DataFrame:
        return form(rows, parts, order, columns, n)

    return over_series(
        df, keys, order, add, back=n - 1, max_rows=max_rows, longest=longest
    )


# --- lag and lead ----------------------------------------------------------


def lag_columns(
    df: DataFrame,
    lags: dict[str, tuple[str, int]],
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Add earlier values: `lags` maps a new column to (metric, rows back).

    Where the distance is less than a row there is no earlier value: null.
    """

    def add(rows: DataFrame, parts: list[Column]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*order)
        return rows.withColumns(
            {
                name: F.lag(metric, k).over(w)
                if k > 0
                else F.lit(None).cast(rows.schema[metric].dataType)
                for name, (metric, k) in lags.items()
            }
        )

    back = max(k for _, k in lags.values())
    return over_series(
        df, keys, order, add, back=back, max_rows=max_rows, longest=longest
    )


def lead_column(
    df: DataFrame,
    metric: str,
    rows_ahead: int,
    name: str = "target",
    keys: Sequence[str] = tuple(schemas.SERIES),
    order: Sequence[str] = ("time",),
    max_rows: int = MAX_ROWS,
    longest: int | None = None,
) -> DataFrame:
    """Add the value `rows_ahead` rows later, which is never the current one."""
    if rows_ahead < 1:
        raise ValueError("a later value lies at least one row ahead")

    def add(rows: DataFrame, parts: list[Column]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*order)
        return rows.withColumn(name, F.lead(metric, rows_ahead).over(w))

    return over_series(
        df, keys, order, add, ahead=rows_ahead, max_rows=max_rows, longest=longest
    )


def first_n_per_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """First `n` rows of each series.

    Up to spark.sql.optimizer.windowGroupLimitThreshold rows Spark itself cuts
    each map task's rows before the shuffle; beyond it we do that by a first
    pass over salted groups, so a long series never meets in one task whole.
    """
    spark = df.sparkSession
    built_in = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > built_in:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
            .withColumn("_rank", F.row_number().over(salted))
            .where(F.col("_rank") <= n)
            .drop("_salt", "_rank")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )
