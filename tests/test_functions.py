import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from energylake.functions import temporal
from energylake.operators import totals
from energylake.options import (
    FeatureOptions,
    ForecastOptions,
    SequenceOptions,
    SyncOptions,
)


def frame(spark, *times):
    return spark.createDataFrame([(t,) for t in times], "time timestamp_ntz")


def test_temporal_features(spark):
    rows = temporal.with_temporal_features(
        frame(
            spark,
            datetime(2024, 1, 15, 8),
            datetime(2024, 1, 15, 12),
            datetime(2024, 1, 15, 18),
            datetime(2024, 1, 20, 10),
        )
    ).collect()
    assert [r["hour_of_day"] for r in rows] == [8, 12, 18, 10]
    assert [r["day_of_week"] for r in rows] == [0, 0, 0, 5]
    assert [r["is_weekend"] for r in rows] == [0, 0, 0, 1]
    assert [r["day_of_month"] for r in rows] == [15, 15, 15, 20]
    for r in rows:
        assert r["hour_sin"] == pytest.approx(math.sin(2 * math.pi * r["hour_of_day"] / 24))
        assert r["day_cos"] == pytest.approx(math.cos(2 * math.pi * r["day_of_week"] / 7))


def test_tou_by_hour(spark):
    df = spark.createDataFrame([(3,), (10,), (17,), (22,)], "hour_of_day int")
    rows = temporal.with_tou_features(df).collect()
    assert [(r["tou_peak"], r["tou_off_peak"], r["tou_shoulder"]) for r in rows] == [
        (0, 1, 0),
        (0, 0, 1),
        (1, 0, 0),
        (0, 1, 0),
    ]
    own = temporal.with_tou_features(df, (2, 4), [(9, 11)]).collect()
    assert [(r["tou_peak"], r["tou_shoulder"]) for r in own] == [
        (1, 0),
        (0, 1),
        (0, 0),
        (0, 0),
    ]


def test_tou_by_label(spark):
    df = spark.createDataFrame(
        [("peak",), ("off_peak",), ("shoulder",), (None,)],
        "grid_price_time_of_use_period string",
    )
    rows = temporal.with_tou_features(df).collect()
    assert [(r["tou_peak"], r["tou_off_peak"], r["tou_shoulder"]) for r in rows] == [
        (1, 0, 0),
        (0, 1, 0),
        (0, 0, 1),
        (0, 0, 0),
    ]


def test_schedule_table_agrees_with_the_flags(spark):
    hours = temporal.schedule_table(spark)
    flags = hours.select("period", *[
        c.alias(n) for n, c in temporal.tou_from_hour(F.col("hour")).items()
    ])
    assert flags.count() == 24
    assert all(r[f"tou_{r['period']}"] == 1 for r in flags.collect())


def test_time_spine(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    hour = temporal.time_spine(spark, start, start + timedelta(hours=1))
    assert hour.count() == 13
    day = temporal.time_spine(spark, start, start + timedelta(days=1), date_only_end=True)
    assert day.count() == 288
    with pytest.raises(ValueError):
        temporal.time_spine(spark, start, start - timedelta(hours=1))


def test_spine_of_rows(spark):
    df = frame(spark, datetime(2024, 1, 1, 0, 3), datetime(2024, 1, 3, 0, 4))
    spine = temporal.spine_of(df, "time", 5)
    assert spine.count() == spine.distinct().count() == 2 * 288 + 1


def test_align(spark):
    df = frame(spark, datetime(2024, 1, 1, 0, 9, 59, 999999), datetime(2024, 1, 1, 0, 10))
    slots = df.select(temporal.align(F.col("time"), 300).cast("timestamp_ntz")).collect()
    assert [r[0].minute for r in slots] == [5, 10]


def test_parts_add_up(spark):
    df = spark.createDataFrame([(1.0, 1.0), (6.0, 6.0), (-0.5, 2.5)], "a double, b double")
    fits = totals.parts_match_total([F.col("a"), F.col("b")], F.lit(2.0))
    assert [r[0] for r in df.select(fits).collect()] == [True, False, True]


@pytest.mark.parametrize(
    "options",
    [
        FeatureOptions(rolling_window_days=0),
        FeatureOptions(lookback_days=-1),
        ForecastOptions(test_size=1.0),
        ForecastOptions(horizon_hours=0),
        ForecastOptions(learning_rate=0),
        SequenceOptions(validation_split=0.0),
        SequenceOptions(sequence_length=0),
        SequenceOptions(fit_scaler_on="test"),
        SyncOptions(batch_size=0),
    ],
)
def test_invalid_options(options):
    with pytest.raises(ValueError):
        options.validate()


def test_default_options_are_valid():
    for options in (FeatureOptions, ForecastOptions, SequenceOptions, SyncOptions):
        options().validate()
