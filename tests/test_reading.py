"""Cursors of series, pages by rank, malformed lines, and early stopping."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from energylake.operators import forecast
from energylake.sources import cursors, snapshots, tables
from energylake.streaming import sync

from .test_streaming import snapshots as some_snapshots

START = datetime(2024, 1, 1)
POINT = "time timestamp, measurement string, device_id string, field string, value double, n int"


def points(spark, series):
    rows = [
        (START + timedelta(seconds=s), "solar", device, "generation_kw", float(i), i)
        for device, times in series.items()
        for i, s in enumerate(times)
    ]
    return spark.createDataFrame(rows, POINT).repartition(3)


def rounds(spark, root, series, limit, order=("time", "n"), start=START):
    read = []
    cursors.read_round(
        points(spark, series), f"{root}/marks",
        lambda rows: read.extend((r.device_id, r.n) for r in rows.collect()), start, limit, order,
    )
    return sorted(read, key=str)


def test_slow_and_fast_series(spark, tmp_path):
    """The limit cuts the fast one; neither skips a row, nor reads one twice."""
    series = {"fast": list(range(100)), "slow": [i * 40 for i in range(5)], None: [3, 500]}
    seen = []
    for _ in range(5):
        found = rounds(spark, tmp_path, series, 30)
        assert sum(d == "fast" for d, _ in found) <= 30
        seen += found
    want = [(d, i) for d, times in series.items() for i in range(len(times))]
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert rounds(spark, tmp_path, series, 30) == []
    # new rows of one series only, and a series that is new
    series["slow"].append(9000)
    series["new"] = [1, 2]
    assert rounds(spark, tmp_path, series, 30) == [("new", 0), ("new", 1), ("slow", 5)]


def test_ties_at_the_limit_are_read_together(spark, tmp_path):
    series = {"a": [0, 5, 5, 5, 9]}
    assert rounds(spark, tmp_path, series, 2, ("time",)) == [("a", i) for i in range(4)]
    assert rounds(spark, tmp_path, series, 2, ("time",)) == [("a", 4)]


def test_a_round_that_dies_is_read_again(spark, tmp_path):
    series = {"a": [0, 1, 2]}

    def failing(rows):
        raise OSError("sink")

    with pytest.raises(OSError, match="sink"):
        cursors.read_round(points(spark, series), f"{tmp_path}/marks", failing, START, 2, ["time"])
    assert rounds(spark, tmp_path, series, 2) == [("a", 0), ("a", 1)]
    # marks that were not written whole do not count
    (tmp_path / "marks" / "9").mkdir()
    assert rounds(spark, tmp_path, series, 2) == [("a", 2)]


def test_rows_before_the_start_are_not_read(spark, tmp_path):
    series = {"a": [0, 1, 2, 3]}
    start = START + timedelta(seconds=2)
    assert rounds(spark, tmp_path, series, 10, start=start) == [("a", 2), ("a", 3)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "long", "string"])
@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_pages_at_any_offset(spark, kind, most):
    """Nulls first, ties, far values: every page is that of the whole order."""
    values = [None] * 7 + [0] * 30 + list(range(-50, 90)) + [10**9, 10**9, 4 * 10**9]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i int").repartition(4)
    if kind.startswith("timestamp"):
        df = df.withColumn("v", F.timestamp_seconds("v").cast(kind))
    elif kind == "string":
        df = df.withColumn("v", F.format_string("%020d", F.col("v") + 100))
    want = [r.i for r in df.orderBy("v", "i").collect()]
    if kind != "string":
        assert want == sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    for number, rows in [(0, 10), (3, 12), (5, 20), (17, 10), (18, 10), (40, 10), (0, 500)]:
        got = [r.i for r in tables.page(df, ["v", "i"], number, rows, most_sorted=most).collect()]
        assert got == want[number * rows : (number + 1) * rows]


def test_malformed_lines_are_kept_and_counted(spark, tmp_path):
    snapshots.write_snapshots(some_snapshots(spark, 4).coalesce(1), f"{tmp_path}/in")
    good = snapshots.snapshot_json(some_snapshots(spark, 1)).first()[0]
    bad = ["{not json", good[:-20], re.sub('"cycles":[0-9]+', '"cycles":"x"', good), '{"device_id":"no time"}']
    (tmp_path / "in" / "bad.txt").write_text("\n".join([bad[0], "", *bad[1:]]))
    for _ in range(2):  # the second time finds nothing new
        sync.start_snapshot_sync(
            snapshots.stream_snapshots(spark, f"{tmp_path}/in", keep_malformed=True),
            f"{tmp_path}/t", f"{tmp_path}/c",
            status_path=f"{tmp_path}/status", quarantine_path=f"{tmp_path}/bad",
        ).awaitTermination()
    lines = [r.line for r in spark.read.parquet(f"{tmp_path}/bad").collect()]
    assert set(bad[:3]) <= set(lines) and len(lines) == 4
    assert sum("no time" in line for line in lines) == 1
    assert sync.synced_readings(spark, f"{tmp_path}/t").count() == 4 * 26
    facts = sync.sync_status(spark, f"{tmp_path}/status").first()
    assert (facts.total_synced, facts.failed, facts.pending) == (4 * 26, 4, 0)
    # without the column they are rows that lack some fields or all
    assert snapshots.read_snapshots(spark, f"{tmp_path}/in").count() == 8


@pytest.mark.parametrize(
    ("losses", "patience", "want"),
    [
        ([5, 4, 3, 2], 2, (4, 4)),
        ([5, 4, 4.5, 4.1, 3, 2], 2, (4, 2)),
        ([5, 4, 4.5, 3.9, 4, 4, 1], 2, (6, 4)),
        ([5, 5, 5], 2, (3, 1)),
        ([5], 1, (1, 1)),
        ([float("nan")] * 3, 1, (3, 3)),
    ],
)
def test_early_stop(losses, patience, want):
    assert forecast.early_stop(losses, patience) == want


def test_a_model_cut_back_is_that_of_fewer_rounds(spark):
    """Longer runs begin with the rounds of shorter ones, and cutting gives the same predictions."""
    df = spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), (F.sin("id") * 5).alias("b"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        df.withColumn("label", F.col("a") * F.col("b"))
    )
    long = GBTRegressor(maxIter=6, maxDepth=3, seed=1).fit(df)
    short = GBTRegressor(maxIter=2, maxDepth=3, seed=1).fit(df)
    cut = forecast.first_trees(long, 2)
    assert cut.getNumTrees == 2
    assert cut.numFeatures == 2
    pairs = zip(cut.transform(df).collect(), short.transform(df).collect(), strict=True)
    assert all(a.prediction == b.prediction for a, b in pairs)
    losses = long.evaluateEachIteration(df, "squared")[:2]
    assert losses == pytest.approx(short.evaluateEachIteration(df, "squared"))
    assert cut.featureImportances.toArray().sum() == pytest.approx(1)
