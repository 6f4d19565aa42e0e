import json
import math
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from energylake import schemas
from energylake.functions import cleaning
from energylake.operators import reshape
from energylake.sources import snapshots as files

TIME = datetime(2023, 3, 4, 5, 10, tzinfo=timezone.utc)
#: fields whose values the tests refer to; all others are numbered through
KNOWN = {"generation_kw": 7.5, "total_load_kw": 3.5, "power_kw": 2.0, "cycles": 41}


def _record(fields, first):
    return {f.name: KNOWN.get(f.name, first + i) for i, f in enumerate(fields)}


SNAPSHOT = {"timestamp": TIME.isoformat(), "device_id": "unit-a"} | {
    f.name: _record(f.dataType.fields, 2.0 * k) | ({"time_of_use_period": "peak"} if f.name == "grid_price" else {})
    for k, f in enumerate(schemas.SNAPSHOT.fields)
    if f.dataType.typeName() == "struct"
}


@pytest.fixture(scope="module")
def snapshots(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("snapshots")
    (folder / "one.jsonl").write_text(json.dumps(SNAPSHOT) + "\n")
    return files.read_snapshots(spark, str(folder))


def test_net_flow(snapshots):
    assert snapshots.first()["net_grid_flow_kw"] == pytest.approx(-2.0)


def test_json_round_trip(spark, snapshots, tmp_path):
    path = str(tmp_path / "out")
    files.write_snapshots(snapshots, path)
    files.write_snapshots(snapshots, path)
    again = files.read_snapshots(spark, path)
    assert again.count() == 2
    assert again.first() == snapshots.first()
    text = json.loads(files.snapshot_json(snapshots).first()[0])
    assert datetime.fromisoformat(text["timestamp"]) == TIME
    assert text["net_grid_flow_kw"] == -2.0


def test_points(snapshots):
    points = reshape.snapshot_points(snapshots).collect()
    assert len(points) == 26
    assert {p["measurement"] for p in points} == set(schemas.MEASUREMENT_FIELDS)
    by_name = {(p["measurement"], p["field"]): p for p in points}
    assert by_name["system", "total_load_kw"]["value"] == 3.5
    assert by_name["system", "net_grid_flow_kw"]["value"] == pytest.approx(-2.0)
    assert by_name["battery", "cycles"]["value"] == 41.0
    assert by_name["grid_price", "price_per_kwh"]["time_of_use_period"] == "peak"
    assert by_name["solar", "generation_kw"]["time_of_use_period"] is None


def test_points_to_readings(spark):
    time = datetime(2024, 6, 15, 14, 30)
    points = spark.createDataFrame(
        [
            (time, "solar", "dev-1", "generation_kw", "7.5"),
            (time, "solar", None, "generation_kw", "8"),
            (None, "solar", "dev-1", "generation_kw", "9"),
            (time, "solar", "dev-1", "generation_kw", None),
            (time, "solar", "dev-1", "generation_kw", "much"),
            (time, "solar", "dev-1", "generation_kw", "nan"),
        ],
        "time timestamp, measurement string, device_id string, field string, value string",
    )
    rows = reshape.points_to_readings(points, "test-site").collect()
    assert [(r["device_id"], r["metric_value"]) for r in rows] == [
        ("dev-1", 7.5),
        ("unknown", 8.0),
    ]
    assert {r["metric_name"] for r in rows} == {"solar.generation_kw"}
    assert {r["site_id"] for r in rows} == {"test-site"}


def test_unknown_measurements_are_skipped(snapshots):
    points = reshape.snapshot_points(snapshots)
    kept = reshape.union_measurements(points, ["solar", "wind"])
    assert {r["measurement"] for r in kept.collect()} == {"solar"}
    strange = points.withColumn("field", F.lit("strange"))
    assert strange.where(reshape.known_fields()).isEmpty()


@pytest.mark.parametrize("places", [0, 1, 2, 3, 4])
def test_rounding_is_that_of_the_binary_value(spark, places):
    rng = np.random.default_rng(places)
    ties = (rng.integers(-20000, 20000, 4000) * 2 + 1) * 0.5 / 10**places
    others = rng.normal(0, 1000, 2000)
    values = [float(v) for v in np.concatenate([ties, others, [0.0, 1.005, 2.675]])]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", cleaning.round_half_even(F.col("v"), places).alias("r"))
    for row in got.collect():
        assert row["r"] == round(row["v"], places), row


def test_pivot_takes_the_first_of_duplicates(spark):
    t1, t2, t3 = (datetime(2024, 1, 15, 12, m) for m in (0, 5, 10))
    rows = [
        (t1, "s", "d", "solar.generation_kw", 5.0, 2),
        (t1, "s", "d", "solar.generation_kw", 9.0, 1),
        (t1, "s", "d", "battery.cycles", 7.0, 1),
        (t2, "s", "d", "battery.power_kw", 1.0, 1),
        (t2, "s", "d", "battery.power_kw", None, 0),
        (t3, "s", "d", "battery.power_kw", None, 0),
        (t3, "s", "d", "solar.generation_kw", math.nan, 0),
    ]
    df = spark.createDataFrame(
        rows,
        "time timestamp, site_id string, device_id string, metric_name string, "
        "metric_value double, seq int",
    )
    wide = reshape.pivot_wide(df, order_col="seq").orderBy("time").collect()
    assert len(wide) == 2
    assert wide[0]["solar_generation_kw"] == 9.0
    assert wide[1]["battery_power_kw"] == 1.0
    assert "battery_cycles" not in wide[0].asDict()
    smallest = reshape.pivot_wide(df).orderBy("time").first()
    assert smallest["solar_generation_kw"] == 5.0
    groups = reshape.duplicate_groups(df).collect()
    assert {(r["metric_name"], r["copies"]) for r in groups} == {
        ("solar.generation_kw", 2),
        ("battery.power_kw", 2),
    }


def test_pivot_needs_one_shuffle(spark, snapshots):
    wide = reshape.pivot_wide(
        reshape.points_to_readings(reshape.snapshot_points(snapshots), "s")
    )
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_declared_projection(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 3.0, 4)], "device_id int, solar_generation_kw double, other double, month int"
    )
    declared = schemas.feature_columns()
    assert len(declared) == 3 + 18 + 9 + 10 + 3 + 6
    table = reshape.project_declared(df, declared)
    assert table.columns == ["device_id", "solar.generation_kw", "month"]
    view = reshape.training_features(table)
    assert view.columns == ["device_id", "solar_generation_kw", "month"]
    available, missing = reshape.select_features(view, schemas.forecast_features())
    assert available == ["month"]
    assert len(missing) == 31 and missing == sorted(missing)
    with pytest.raises(ValueError, match="missing required"):
        reshape.require_columns(df, ["time"])


def test_not_a_number_becomes_null(spark):
    values = [1.0, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v, "x") for v in values], "`a.b` double, c string")
    got = [r[0] for r in cleaning.nan_to_null(df).collect()]
    assert got == [1.0, None, None, None, None]


def test_time_texts(spark):
    df = spark.createDataFrame(
        [("2024-06-15T14:30:00Z",), ("2024-06-15T06:30:00-08:00",), ("soon",)],
        "text string",
    )
    time = cleaning.parse_time(F.col("text"))
    rows = df.select(cleaning.rfc3339(time), cleaning.iso_seconds(time)).collect()
    assert [r[0] for r in rows] == ["2024-06-15T14:30:00Z"] * 2 + [None]
    assert rows[0][1] == "2024-06-15T14:30:00+00:00"
