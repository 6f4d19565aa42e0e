"""Exact intervals: medians, and windows whose length is a column."""

import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from energylake.operators import intervals
from energylake.plans import features
from energylake.options import FeatureOptions
from energylake.sources import tables

START = datetime(2024, 1, 1)


def table(spark, series):
    """`series`: name to seconds of its samples; the value is the number of the sample."""
    rows = [
        (name, START + timedelta(seconds=s), float((i * 7) % 11) if i % 5 else None)
        for name, times in series.items()
        for i, s in enumerate(times)
    ]
    return spark.createDataFrame(rows, "device string, time timestamp, v double").repartition(3)


def steps(n, seconds):
    return [i * seconds for i in range(n)]


SERIES = {
    "half": steps(300, 0.5),
    "ten": steps(200, 10),
    "seven": steps(90, 420),
    "late": [i * 2700 + (i % 3) for i in range(60)],
    "one": [5.0],
    None: steps(50, 60),
    "same": [1.0] * 9,
}


def medians(values_of):
    out = {}
    for name, times in values_of.items():
        gaps = [round((b - a) * 1e6) for a, b in zip(sorted(times), sorted(times)[1:])]
        out[name] = (len(times), statistics.median(gaps) if gaps else None)
    return out


def test_median_of_every_series(spark):
    got = {
        r.device: (r.series_rows, r.interval_micros)
        for r in intervals.series_intervals(table(spark, SERIES), ["device"], ["time"]).collect()
    }
    assert got == medians(SERIES)


def test_medians_of_far_values(spark):
    """Values in different ranges, ties at the middle, and an even number of them."""
    values = {
        "a": [0, 1, 1 << 33, (1 << 33) + 1], "b": [5] * 7, "c": [1 << 16, (1 << 16) + 1, 3, 1 << 40],
        "d": [9], None: [2, 4], "e": list(range(1000)),
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("f", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: r["median"] for r in intervals.median_per_series(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(vs) for k, vs in values.items()}


LENGTH = {"half": 40, "ten": 7, "seven": 2, "late": 1, "one": 1, None: 13, "same": 3}


def with_lengths(df):
    length = F.lit(LENGTH[None])
    for name, n in LENGTH.items():
        if name:
            length = F.when(F.col("device") == name, n).otherwise(length)
    return df.withColumn("n", length.cast("long"))


def plain(series):
    """device, time, value: mean, deviation, n rows back and n rows ahead."""
    out = {}
    for name, times in series.items():
        n = LENGTH[name]
        values = [float((i * 7) % 11) if i % 5 else None for i in range(len(times))]
        for i, t in enumerate(times):
            frame = values[max(0, i - n + 1) : i + 1]
            full = len(frame) == n and None not in frame
            out[name, START + timedelta(seconds=t)] = (
                statistics.mean(frame) if full else None,
                statistics.stdev(frame) if full and n > 1 else None,
                values[i - n] if i >= n else None,
                values[i + n] if i + n < len(values) else None,
            )
    return out


@pytest.mark.parametrize("max_rows", [2_000_000, 35])
def test_windows_of_own_length(spark, max_rows):
    """One plan for all lengths; long series are cut."""
    series = {k: v for k, v in SERIES.items() if k != "same"}
    df = with_lengths(table(spark, series))
    widest, keys, order = 40, ["device"], ["time"]
    rows = intervals.rolling_mean_std(df, {"v": ("mean", "std")}, "n", widest, keys, order, max_rows)
    rows = intervals.lag_columns(rows, {"back": ("v", "n")}, widest, keys, order, max_rows)
    rows = intervals.lead_column(rows, "v", "n", widest, "ahead", keys, order, max_rows)
    want = plain(series)
    got = rows.collect()
    assert len(got) == len(want)
    for r in got:
        mean, std, back, ahead = want[r.device, r.time]
        assert (r.back, r.ahead) == (back, ahead), (r.device, r.time)
        assert r["mean"] == (None if mean is None else pytest.approx(mean, abs=1e-12))
        assert r["std"] == (None if std is None else pytest.approx(std, abs=1e-12))


def test_no_row_back_is_null(spark):
    df = table(spark, {"ten": steps(5, 10)}).withColumn("k", F.lit(0).cast("long"))
    rows = intervals.lag_columns(df, {"back": ("v", "k")}, 0, ["device"], ["time"]).collect()
    assert {r.back for r in rows} == {None}


def test_row_counts(spark):
    micros = [(x,) for x in (500_000.0, 1e7, 4.2e8, 2.7e9, 3e8, 7.2e9, 1.8e11, 0.0, None)]
    df = spark.createDataFrame(micros, "interval_micros double")
    got = df.select(intervals.day_rows(1), intervals.hour_rows(), intervals.horizon_rows(2)).collect()
    assert [tuple(r) for r in got] == [
        (172800, 7200, 14400), (8640, 360, 720), (206, 9, 17), (32, 1, 3), (288, 12, 24), (12, 0, 1),
        (1, 0, 1), (288, 12, 24), (288, 12, 24),
    ]


def test_labels_by_own_interval(spark):
    """Devices of 5, 10 and 45 minutes: each label lies the same time ahead."""
    series = {"five": steps(60, 300), "ten": steps(40, 600), "late": steps(30, 2700)}
    df = table(spark, series).withColumn("minutes", F.unix_seconds("time") / 60.0)
    rows = intervals.lead_by_interval(df, "minutes", 3, (), ["device"], ["time"]).collect()
    assert {(r.device, r.label - r.minutes) for r in rows} == {(d, 180.0) for d in series}
    assert len(rows) == (60 - 36) + (40 - 18) + (30 - 4)
    with pytest.raises(ValueError, match="not found"):
        intervals.lead_by_interval(df, "nothing", 1)


def test_features_of_a_ten_second_device(spark):
    """A day is 8640 rows at ten seconds, where a usual interval would make it 1440."""
    names = ["solar.generation_kw", "home_load.total_load_kw", "battery.soc_percent", "grid_price.price_per_kwh", "system.net_grid_flow_kw"]
    n = 8700
    times = spark.range(n).select(
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 10)).alias("time"), "id"
    )
    readings = times.select(
        "time", F.lit("s").alias("site_id"), F.lit("d").alias("device_id"),
        F.explode(F.array(*map(F.lit, names))).alias("metric_name"),
        (F.col("id") % 17).cast("double").alias("metric_value"),
    )
    rows = features.build_features(readings, FeatureOptions(rolling_window_days=1)).orderBy("time").collect()
    assert len(rows) == n - 8640 + 1
    assert rows[0].time == START + timedelta(seconds=10 * 8639)
    mean = statistics.mean((i % 17) for i in range(8640))
    assert rows[0].solar_generation_kw_rolling_avg_1d == pytest.approx(mean)
    with pytest.raises(ValueError, match="intervals"):
        FeatureOptions(intervals="guess").validate()


def readings(spark, devices, shift=0.0, minutes=60, first=0, n=40):
    names = ["solar.generation_kw", "home_load.total_load_kw", "battery.soc_percent", "grid_price.price_per_kwh", "system.net_grid_flow_kw"]
    rows = [
        (START + timedelta(minutes=minutes * i), "s", d, m, float(i % 7) + shift)
        for d in devices for i in range(first, first + n) for m in names
    ]
    schema = "time timestamp, site_id string, device_id string, metric_name string, metric_value double"
    return spark.createDataFrame(rows, schema)


def test_changed_series_are_built_as_by_the_whole_job(spark, tmp_path):
    """New, late, changed and repeated readings, through two checkpoints."""
    path, state = f"{tmp_path}/readings", f"{tmp_path}/state"
    options = FeatureOptions(rolling_window_days=1)
    span = {"start": START - timedelta(days=9), "end": START + timedelta(days=9)}

    def store(rows, epoch, batch):
        version = F.lit(epoch * tables.BATCHES + batch).cast("long")
        tables.append(rows.withColumn(tables.VERSION, version), path)

    def changed():
        return features.run_changed(spark, path, f"{tmp_path}/a", state, options, **span)

    def same():
        features.run(spark, path, f"{tmp_path}/b", options, **span)
        a, b = (sorted(map(str, tables.table(spark, f"{tmp_path}/{t}").collect())) for t in "ab")
        return a == b and len(a) > 0

    store(readings(spark, ["x", "y", "z"]), 0, 0)
    assert changed()["series_built"] == 3 and same()
    assert changed() == {"status": "unchanged", "series_built": 0, "records_processed": 0, "records_stored": 0}
    store(readings(spark, ["y"], shift=2.0, first=30, n=3), 0, 1)
    assert changed()["series_built"] == 1 and same()
    store(readings(spark, ["z"], first=-4, n=4), 1, 0)
    store(readings(spark, ["w"]), 1, 0)
    assert changed()["series_built"] == 2 and same()
    # the first checkpoint goes on, with versions below those of the second
    store(readings(spark, ["x"], first=40, n=2), 0, 2)
    assert changed()["series_built"] == 1 and same()
    with pytest.raises(ValueError, match="one series"):
        features.run_changed(spark, path, "a", state, FeatureOptions(partition_cols=[]))


def test_errors_of_the_program_are_raised(spark, tmp_path, monkeypatch):
    tables.append(readings(spark, ["x"], n=2), f"{tmp_path}/r")
    monkeypatch.setattr(features, "build_features", lambda *args: {}["missing"])
    with pytest.raises(KeyError):
        features.run(spark, f"{tmp_path}/r", f"{tmp_path}/t", start=START, end=START + timedelta(days=1))
