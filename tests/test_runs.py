"""Linear fits on blocks of rows against Spark's fit on whole runs."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from energylake.operators import dataset, forecast, runs
from energylake.options import SequenceOptions

START = datetime(2024, 1, 1)


def table(spark, lengths, seed=1, missing=0.0, mean=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for name, n in lengths.items():
        v = mean + np.cumsum(rng.normal(0, 1, n)) * 0.1 + rng.normal(0, 1, n)
        for i in range(n):
            value = None if rng.random() < missing else float(v[i])
            rows.append((name, START + timedelta(minutes=5 * i), value, float(i % 24)))
    return spark.createDataFrame(rows, "device string, time timestamp, v double, hour double").repartition(4)


LENGTHS = {"a": 700, "b": 260, "short": 5, None: 90}


def flattened(df, length, ahead, stride, reg):
    """Every run stored whole, split, and fitted by Spark."""
    rows = dataset.sequences(df, ["v", "hour"], "v", length, ahead, ["device"], ["time"], stride)
    whole = rows.where(forecast._complete())
    split = dataset.chrono_split(whole, 0.2, 0.15, ["device"], ["time"])
    vectors = split.select(
        array_to_vector(F.flatten("x")).alias("features"), F.col("y").alias("label"), "split"
    ).cache()
    model = LinearRegression(regParam=reg, solver="normal").fit(vectors.where("split = 'train'"))
    counts = {r["split"]: r["count"] for r in vectors.groupBy("split").count().collect()}
    return model, counts, rows.count() - whole.count(), model.transform(vectors.where("split = 'test'"))


@pytest.mark.parametrize(
    ("length", "ahead", "stride", "missing", "reg", "mean"),
    [(1, 1, 1, 0, 0, 0), (6, 3, 1, 0.05, 0, 0), (12, 0, 1, 0, 0.3, 50), (30, 2, 4, 0.002, 0.01, 1000)],
)
def test_fit_is_that_of_whole_runs(spark, monkeypatch, length, ahead, stride, missing, reg, mean):
    monkeypatch.setattr(runs, "BLOCK_ROWS", 40)
    df = table(spark, LENGTHS, missing=missing, mean=mean)
    model, counts, left_out, scored = flattened(df, length, ahead, stride, reg)
    linear = runs.LinearRuns.of(
        df, ["v", "hour"], "v", runs.Shape(length, ahead, 2, stride), ["device"], ["time"], 0.2, 0.15
    )
    assert linear.counts() == (counts, left_out)
    got = linear.fit(reg)
    assert got.coefficients.toArray() == pytest.approx(model.coefficients.toArray(), abs=1e-6)
    assert got.intercept == pytest.approx(model.intercept, abs=1e-5 * max(1, mean))
    pairs = sorted((r.label, r.prediction) for r in linear.scored(got).collect())
    want = sorted((r.label, r.prediction) for r in scored.collect())
    assert np.array(pairs) == pytest.approx(np.array(want), abs=1e-5 * max(1, mean))


def test_long_runs_take_little_space(spark):
    """At the default length rows are stored twice, not 288 times, and long series may be cut."""
    df = table(spark, {"a": 3000, "b": 1000})
    shape = runs.Shape(288, 12, 1)
    blocks = runs.stored_blocks(df, ["v"], "v", shape, ["device"], ["time"])
    stored = blocks.select(F.sum(F.size("y")), F.max(F.size("y"))).first()
    assert stored[0] <= 2.1 * 4000
    assert stored[1] == shape.block + shape.reach
    cut = runs.stored_blocks(df, ["v"], "v", shape, ["device"], ["time"], max_rows=500)
    assert sorted(map(str, cut.collect())) == sorted(map(str, blocks.collect()))


def test_series_without_runs(spark):
    df = table(spark, {"a": 5, "b": 3})
    linear = runs.LinearRuns.of(df, ["v"], "v", runs.Shape(9, 1, 1), ["device"], ["time"], 0.2, 0.15)
    assert linear.counts() == ({}, 0)
    with pytest.raises(ValueError, match="no whole run"):
        linear.fit()


def test_a_stored_linear_forecast_predicts_alike(spark, tmp_path):
    df = table(spark, {"a": 400}).withColumns({"site_id": F.lit("s"), "device_id": F.col("device")})
    options = SequenceOptions(sequence_length=20, regressor="linear", horizon_hours=1, min_rows=10)
    trained = forecast.train_sequence_forecast(df, "v", options, features=["v", "hour"])
    assert trained.samples["train"] + trained.samples["validation"] + trained.samples["test"] == 400 - 19 - 12
    trained.save(f"{tmp_path}/m")
    loaded = forecast.Forecast.load(spark, f"{tmp_path}/m")
    want = [r.prediction for r in trained.predict(df).orderBy("time").collect()]
    assert [r.prediction for r in loaded.predict(df).orderBy("time").collect()] == want
    assert len(want) == 381 and None not in want
