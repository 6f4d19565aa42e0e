"""Calendar features, time grids and time-of-use encodings."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def calendar(time: Column) -> dict[str, Column]:
    """Calendar features of a timestamp; Monday is day 0."""
    day = F.weekday(time)
    return {
        "hour_of_day": F.hour(time),
        "day_of_week": day,
        "day_of_month": F.dayofmonth(time),
        "month": F.month(time),
        "is_weekend": (day >= 5).cast("int"),
    }


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle of `period` steps."""
    angle = value * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def with_temporal_features(df: DataFrame, time_col: str = "time") -> DataFrame:
    """Add the nine temporal features."""
    parts = calendar(F.col(time_col))
    hour_sin, hour_cos = cyclic(parts["hour_of_day"], 24)
    day_sin, day_cos = cyclic(parts["day_of_week"], 7)
    return df.withColumns(
        parts
        | {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "day_sin": day_sin,
            "day_cos": day_cos,
        }
    )


def _within(hour: Column, span: tuple[int, int]) -> Column:
    start, end = span
    return (hour >= start) & (hour < end)


def tou_from_label(label: Column) -> dict[str, Column]:
    """One-hot columns of a time-of-use label; a missing label gives zeros."""
    return {
        f"tou_{period}": F.coalesce(label == period, F.lit(False)).cast("int")
        for period in ("peak", "off_peak", "shoulder")
    }


def tou_from_hour(
    hour: Column,
    peak: tuple[int, int] = (16, 21),
    shoulder: list[tuple[int, int]] | tuple = ((7, 16), (21, 22)),
) -> dict[str, Column]:
    """One-hot columns from the hour; end hours are exclusive."""
    in_peak = _within(hour, peak)
    in_shoulder = F.lit(False)
    for span in shoulder:
        in_shoulder = in_shoulder | _within(hour, span)
    return {
        "tou_peak": in_peak.cast("int"),
        "tou_off_peak": (~in_peak & ~in_shoulder).cast("int"),
        "tou_shoulder": in_shoulder.cast("int"),
    }


def with_tou_features(
    df: DataFrame,
    peak: tuple[int, int] = (16, 21),
    shoulder: list[tuple[int, int]] | tuple = ((7, 16), (21, 22)),
    label_col: str = "grid_price_time_of_use_period",
    hour_col: str = "hour_of_day",
) -> DataFrame:
    """Add the time-of-use one-hots, from the label if present, else the hour."""
    if label_col in df.columns:
        return df.withColumns(tou_from_label(F.col(label_col)))
    if hour_col in df.columns:
        return df.withColumns(tou_from_hour(F.col(hour_col), peak, shoulder))
    return df


def schedule_table(
    spark: SparkSession,
    peak: tuple[int, int] = (16, 21),
    shoulder: list[tuple[int, int]] | tuple = ((7, 16), (21, 22)),
) -> DataFrame:
    """The time-of-use schedule as a table of 24 rows (hour, period)."""
    hour = F.col("id").cast("int")
    flags = tou_from_hour(hour, peak, shoulder)
    period = F.lit("off_peak")
    for name in ("shoulder", "peak"):
        period = F.when(flags[f"tou_{name}"] == 1, name).otherwise(period)
    return spark.range(24).select(hour.alias("hour"), period.alias("period"))


def label_by_schedule(df: DataFrame, schedule: DataFrame, hour: Column) -> DataFrame:
    """Join the period of each row's hour; the schedule has 24 rows."""
    return (
        df.withColumn("hour", hour)
        .join(F.broadcast(schedule), "hour", "left")
        .drop("hour")
    )


def align(time: Column, seconds: int) -> Column:
    """Start of the `seconds`-wide interval a timestamp falls into."""
    whole = F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000))
    return F.timestamp_micros(whole * (seconds * 1_000_000))


def month_start(time: Column) -> Column:
    return F.trunc(time.cast("date"), "month")


def time_spine(
    spark: SparkSession,
    start: datetime,
    end: datetime,
    minutes: int = 5,
    date_only_end: bool = False,
) -> DataFrame:
    """Timestamps from start to end, both included, `minutes` apart.

    An end given as a bare date is exclusive.
    """
    if date_only_end:
        end = end - timedelta(minutes=minutes)
    if end < start:
        raise ValueError("end must not be before start")
    step = minutes * 60_000_000
    origin = datetime(1970, 1, 1, tzinfo=start.tzinfo)
    first = (start - origin) // timedelta(microseconds=1)
    steps = (end - start) // timedelta(minutes=minutes)
    return spark.range(steps + 1).select(
        F.timestamp_micros(F.lit(first) + F.col("id") * step).alias("time")
    )


def spine_of(df: DataFrame, time_col: str, minutes: int) -> DataFrame:
    """Time spine from the earliest to the latest row of `df`.

    The spine is spread by days before it is filled in, so one task holds the
    points of single days only.
    """
    step = minutes * 60_000_000
    span = df.agg(
        F.unix_micros(F.min(time_col).cast("timestamp")).alias("lo"),
        F.unix_micros(F.max(time_col).cast("timestamp")).alias("hi"),
    )
    block = max(1, 1440 // minutes)
    blocks = span.select(
        "lo",
        "hi",
        F.explode(
            F.sequence(
                F.lit(0).cast("long"),
                F.floor((F.col("hi") - F.col("lo")) / (step * block)),
            )
        ).alias("b"),
    ).repartition("b")
    points = blocks.select(
        "hi",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(block - 1)),
                lambda i: F.col("lo") + (F.col("b") * block + i) * step,
            )
        ).alias("t"),
    )
    return points.where(F.col("t") <= F.col("hi")).select(
        F.timestamp_micros("t").alias("time")
    )


