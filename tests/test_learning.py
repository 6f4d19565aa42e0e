"""Scaling, metrics, comparison and forecasts."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from energylake.operators import dataset, forecast, metrics, windows
from energylake.options import ForecastOptions, SequenceOptions
from energylake.sources import tables

START = datetime(2024, 1, 1)


def steps(spark, n, minutes=5, device="d", value=lambda i: float(i)):
    rows = [
        (START + timedelta(minutes=minutes * i), "s", device, value(i), i)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "time timestamp, site_id string, device_id string, y double, i int"
    )


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0), (2.0, 5.0), (None, 5.0), (6.0, 5.0)], "a double, b double"
    )
    scaler = dataset.Scaler.fit(df, ["a", "b"])
    assert scaler.std == pytest.approx({"a": np.std([1, 2, 6]), "b": 1.0})
    rows = scaler.transform(df).collect()
    assert rows[0]["a"] == pytest.approx((1 - 3) / np.std([1, 2, 6]))
    assert rows[2]["a"] is None
    assert [r["b"] for r in rows] == [0.0] * 4


def test_sequence_count(spark):
    df = steps(spark, 500)
    rows_ahead = dataset.horizon_rows(df, 24)
    assert rows_ahead == 288
    assert dataset.sequences(df, ["y"], "y", 24, rows_ahead).count() == 189
    with pytest.raises(ValueError, match="not found"):
        dataset.sequences(df, ["y"], "z", 24, 1)


def test_missing_target_is_left_out_but_missing_feature_kept(spark):
    df = steps(spark, 10).withColumn("x", F.when(F.col("i") != 2, F.col("y")))
    df = df.withColumn("t", F.when(F.col("i") != 6, F.col("y")).otherwise(float("nan")))
    runs = dataset.sequences(df, ["x"], "t", 3, 1).orderBy("time").collect()
    assert [r["y"] for r in runs] == [3.0, 4.0, 5.0, 7.0, 8.0, 9.0]
    assert runs[0]["x"] == [[0.0], [1.0], [None]]


@pytest.mark.parametrize(
    "minutes,per_hour,per_day",
    [(5, 12, 288), (15, 4, 96), (60, 1, 24), (120, 0, 12), (360, 0, 4), (0, 12, 288)],
)
def test_samples(minutes, per_hour, per_day):
    assert windows.samples_per_hour(float(minutes)) == per_hour
    assert windows.samples_per_day(float(minutes)) == per_day
    assert windows.rolling_rows(float(minutes), 7) == 7 * per_day


@pytest.mark.parametrize(
    "minutes,rows", [(5, 288), (15, 96), (60, 24), (120, 12), (720, 2), (1440, 1), (9000, 1), (0, 288), (None, 288)]
)
def test_horizon_is_never_the_row_itself(minutes, rows):
    assert windows.horizon_samples(24, minutes) == rows


def test_label_is_a_later_row_however_rare_the_samples(spark):
    df = steps(spark, 40, minutes=120)
    assert dataset.horizon_rows(df, 1) == 1
    labelled = dataset.lead_by_class(df, "y", 1)
    assert labelled.count() == 39
    assert labelled.where("label <> y + 1").isEmpty()
    with pytest.raises(ValueError, match="row"):
        dataset.lead_target(df, "y", 0)


def test_series_have_their_own_interval_class(spark):
    df = steps(spark, 60).union(steps(spark, 60, 15, "e")).union(steps(spark, 60, 14, "f"))
    df = df.union(steps(spark, 1, device="g"))
    facts = {r.device_id: r for r in windows.series_facts(df).collect()}
    assert {d: r.interval_class for d, r in facts.items()} == {"d": 5, "e": 15, "f": 15, "g": 5}
    assert facts["f"].interval_minutes == 14 and facts["g"].interval_minutes is None
    assert facts["e"].series_rows == 60
    got = dataset.lead_by_class(df, "y", 2).collect()
    ahead = {"d": 24, "e": 8, "f": 8}
    assert all(r.label == r.y + ahead[r.device_id] for r in got)
    assert len(got) == 36 + 52 + 52


def test_every_run_is_used_by_default(spark):
    """Without a stride, 24 rows a run and 3 rows ahead give 200 - 24 - 3 + 1 runs."""
    got = forecast.train_sequence_forecast(
        steps(spark, 200), "y", SequenceOptions(sequence_length=24, regressor="linear"),
        rows_ahead=3, features=["y"],
    )
    assert sum(got.samples.values()) == 200 - 24 - 3 + 1


@pytest.mark.parametrize("keys", [["site_id", "device_id"], []])
def test_partitioning_of_the_input_does_not_matter(spark, keys):
    """Devices on one clock, whose rows tie on time."""
    df = daily(spark, 200).union(daily(spark, 200, "e")).union(daily(spark, 200, "f"))
    df = df.withColumn("noise", F.pmod(F.xxhash64("time", "device_id"), F.lit(1000)) / 100)
    got = []
    for shape in (df.coalesce(1), df.orderBy(F.desc("device_id"), F.desc("time")), df.repartition(7)):
        options = ForecastOptions(partition_cols=keys, **OPTIONS)
        trained = forecast.train_forecast(
            shape, "noise", options, rows_ahead=3, features=["hour_of_day", "noise"]
        )
        sequence = forecast.train_sequence_forecast(
            shape, "noise", SequenceOptions(sequence_length=3, regressor="linear", partition_cols=keys),
            rows_ahead=2, features=["noise"],
        )
        assert trained.options["order"][0] == "time"
        runs = sequence.predict(shape).select("time", "prediction").collect()
        got.append((trained.metrics, sequence.metrics, sorted(map(tuple, runs))))
    for metrics_, sequence_metrics, runs in got[1:]:
        assert metrics_ == pytest.approx(got[0][0])
        assert sequence_metrics == pytest.approx(got[0][1])
        assert [t for t, _ in runs] == [t for t, _ in got[0][2]]
        assert [p for _, p in runs] == pytest.approx([p for _, p in got[0][2]])


def test_training_job(spark, tmp_path):
    path = str(tmp_path / "training")
    df = daily(spark).union(daily(spark, device="e")).union(daily(spark, 300).withColumn("site_id", F.lit("other")))
    holes = df.withColumn("hour_of_day", F.when(F.dayofmonth("time") != 3, F.col("hour_of_day")))
    tables.append(holes, path)
    options = ForecastOptions(site_id="s", **OPTIONS)
    got = forecast.run(spark, path, str(tmp_path / "models"), options)
    assert got["status"] == "success", got
    # two series of 600 rows less a horizon of 24, and less the holes of one day
    assert sum(got["load"].samples.values()) == 2 * (576 - 24)
    assert got["load"].left_out == 2 * 24
    again = forecast.Forecast.load(spark, f"{tmp_path}/models/solar")
    assert again.metrics == got["solar"].metrics and again.left_out == 48
    span = dict(start=START, end=START + timedelta(days=10))
    part = forecast.run(spark, path, str(tmp_path / "m2"), options, **span)
    assert sum(part["load"].samples.values()) == 2 * (241 - 24 - 24)
    assert forecast.run(spark, path, "x", ForecastOptions(enabled=False))["status"] == "disabled"
    assert forecast.run(spark, path, "x", ForecastOptions(site_id="nowhere"))["status"] == "no_data"
    assert forecast.run(spark, str(tmp_path / "nothing"), "x")["status"] == "error"


def test_samples_without_any_gap(spark):
    one = steps(spark, 1)
    assert windows.median_interval_minutes(one) is None
    assert windows.first_interval_minutes(one) is None
    assert windows.samples_per_hour(None) == 12
    assert windows.rolling_rows(None, 7) == 2016


@pytest.mark.parametrize("seed", range(4))
def test_median_of_any_whole_numbers(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 10 ** (3 * seed + 3), 301 + seed).tolist() + [7] * 50
    df = spark.createDataFrame([(v,) for v in values], "gap_micros long")
    assert windows.median_gap(df).first()[0] == np.median(values)


def test_devices_on_one_clock(spark):
    """Mixed, the rows of one instant have no distance; per device they have."""
    df = steps(spark, 20).union(steps(spark, 20, device="e")).union(
        steps(spark, 20, device="f")
    )
    assert windows.median_interval_minutes(df) == 5
    assert windows.first_interval_minutes(df) == 5
    assert windows.first_interval_minutes(df, []) == 0
    assert dataset.horizon_rows(df, 2, []) == 24
    mixed = windows.median_interval_minutes(df, [], ["time", "device_id"])
    assert mixed == 0 and windows.samples_per_hour(mixed) == 12


def measured(spark, pairs, by=None):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "y double, p double")
    return metrics.forecast_metrics(df, "y", "p", 10.0).first()


def test_metrics(spark):
    pairs = [(10, 11), (0, 1), (20, 18), (-5, -5)]
    y, p = np.array(pairs, dtype=float).T
    got = measured(spark, pairs)
    assert got["mae"] == pytest.approx(np.abs(y - p).mean())
    assert got["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    some = y != 0
    assert got["mape"] == pytest.approx(np.abs((y - p)[some] / y[some]).mean() * 100)
    assert got["mae_percent"] == pytest.approx(np.abs(y - p).mean() / y.mean() * 100)
    assert got["meets_target"] is False


def test_metrics_without_mean_or_spread(spark):
    zero_mean = measured(spark, [(1, 2), (-1, 0)])
    assert zero_mean["mae_percent"] == 0.0 and zero_mean["meets_target"] is True
    zeros = measured(spark, [(0, 1), (0, 1)])
    assert zeros["mape"] == 0.0 and zeros["r2"] == 0.0
    exact = measured(spark, [(3, 3), (3, 3)])
    assert exact["r2"] == 1.0 and exact["meets_target"] is True


def model_metrics(mae, rmse, r2, percent):
    return dict(
        mae=mae, rmse=rmse, r2=r2, mape=1.0, target_mean=1.0,
        mae_percent=percent, meets_target=False,
    )


def test_comparison(spark):
    base = model_metrics(0.5, 0.7, 0.8, 10.0)
    got = {
        r["target"]: r
        for r in forecast.compare_models(
            spark,
            {
                "better": model_metrics(0.3, 0.42, 0.9, 4.0),
                "worse": model_metrics(0.8, 0.9, 0.6, 16.0),
                "equal": base,
                "perfect base": base,
                "alone": base,
            },
            {
                "better": base,
                "worse": base,
                "equal": base,
                "perfect base": model_metrics(0.0, 0.0, 1.0, 0.0),
            },
        ).collect()
    }
    assert set(got) == {"better", "worse", "equal", "perfect base"}
    assert got["better"]["mae_percent_improvement"] == pytest.approx(40.0)
    assert got["better"]["rmse_percent_improvement"] == pytest.approx(40.0)
    assert got["better"]["r2_absolute_improvement"] == pytest.approx(0.1)
    assert got["better"]["is_better"] and got["better"]["meets_target"]
    assert got["worse"]["mae_percent_improvement"] == pytest.approx(-60.0)
    assert not got["worse"]["is_better"]
    assert got["equal"]["mae_percent_improvement"] == 0.0
    assert not got["equal"]["is_better"]
    assert got["perfect base"]["mae_percent_improvement"] == 0.0


def test_best_epoch(spark):
    schema = "epoch int, train_loss double, validation_loss double"
    held = spark.createDataFrame([(1, 3.0, 2.0), (2, 1.0, 1.5), (3, 0.5, 1.5)], schema)
    assert metrics.best_epoch(held).first()["best_epoch"] == 2
    bare = spark.createDataFrame([(1, 3.0, None), (2, 1.0, None), (3, 0.5, None)], schema)
    assert metrics.best_epoch(bare).first()["best_epoch"] == 3


# --- training --------------------------------------------------------------


def daily(spark, n=600, device="d"):
    """A noiseless daily curve, sampled every hour."""
    rows = [
        (
            START + timedelta(hours=i), "s", device, i % 24,
            10 + 5 * float(np.sin(2 * np.pi * i / 24)),
            4 + 3 * float(np.cos(2 * np.pi * i / 24)),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "time timestamp, site_id string, device_id string, hour_of_day int, "
        "`home_load.total_load_kw` double, `solar.generation_kw` double",
    )


OPTIONS = dict(n_estimators=8, max_depth=5, learning_rate=0.5)


@pytest.fixture(scope="module")
def trained(spark):
    df = daily(spark).union(daily(spark, device="e"))
    return forecast.train_all(df, ForecastOptions(**OPTIONS))


def test_train_all(spark, trained):
    assert trained["status"] == "success"
    assert trained["features_used"] == 1
    for name in ("load", "solar"):
        assert trained[name].metrics["r2"] > 0.98
        assert trained[name].metrics["meets_target"]
        # 600 rows less a horizon of 24, in both series
        assert trained[name].samples == {"train": 2 * 460, "test": 2 * 116}
        assert trained[name].importance == {"hour_of_day": pytest.approx(1.0)}


def test_save_load_predict(spark, trained, tmp_path):
    paths = {}
    for name in ("load", "solar"):
        paths[name] = str(tmp_path / name)
        trained[name].save(paths[name])
    again = forecast.Forecast.load(spark, paths["load"])
    assert again.metrics == trained["load"].metrics
    assert again.features == ["hour_of_day"]
    df = daily(spark, 48)
    assert (
        again.predict(df).select("prediction").collect()
        == trained["load"].predict(df).select("prediction").collect()
    )
    report = forecast.stored_metrics(spark, paths).collect()
    assert {r["target"]: r["mae"] for r in report} == {
        n: trained[n].metrics["mae"] for n in paths
    }
    top = forecast.importance_frame(spark, again).first()
    assert top["feature"] == "hour_of_day"
    holed = df.withColumn("hour_of_day", F.when(F.hour("time") != 7, F.col("hour_of_day")))
    assert again.predict(holed).count() == 48
    assert again.predict(holed).where("prediction is null").count() == 2


def test_train_all_statuses(spark):
    df = daily(spark, 50)
    assert forecast.train_all(df, ForecastOptions(enabled=False))["status"] == "disabled"
    assert forecast.train_all(df.where("false"))["status"] == "no_data"
    failed = forecast.train_all(df)
    assert failed["status"] == "error"
    assert "Insufficient data" in failed["error"]
    with pytest.raises(ValueError, match="not found"):
        forecast.train_forecast(df, "wind", rows_ahead=1)


@pytest.mark.parametrize("regressor", ["gbt", "linear"])
def test_sequence_forecast(spark, regressor, tmp_path):
    df = daily(spark, 400)
    options = SequenceOptions(
        sequence_length=6, regressor=regressor, target_mae_percent=5.0, **OPTIONS
    )
    got = forecast.train_sequence_forecast(
        df, "home_load.total_load_kw", options, rows_ahead=3,
        features=["home_load_total_load_kw", "hour_of_day"],
    )
    assert got.metrics["r2"] > 0.95
    runs = 400 - 6 - 3 + 1
    train = int(runs * 0.8)
    inner = int(train * 0.85)
    assert got.samples == {
        "train": inner, "validation": train - inner, "test": runs - train
    }
    if regressor == "gbt":
        losses = [h["validation_loss"] for h in got.history]
        assert got.best_epoch == int(np.argmin(losses)) + 1
    got.save(str(tmp_path / "m"))
    again = forecast.Forecast.load(spark, str(tmp_path / "m"))
    assert again.predict(df).count() == 400 - 6 + 1
    assert again.predict(daily(spark, 4)).count() == 1  # padded
    holed = daily(spark, 40).withColumn(
        "hour_of_day", F.when(F.dayofmonth("time") == 1, F.col("hour_of_day"))
    )
    predicted = again.predict(holed)
    assert predicted.count() == 40 - 6 + 1  # every run is there
    assert predicted.where("prediction is not null").count() == 24 - 6 + 1


def test_sequence_forecast_needs_rows(spark):
    with pytest.raises(ValueError, match="Insufficient data"):
        forecast.train_sequence_forecast(
            daily(spark, 20), "solar.generation_kw",
            SequenceOptions(sequence_length=24), rows_ahead=3,
            features=["hour_of_day"],
        )
