from datetime import datetime

import pytest
from pyspark.sql import functions as F

from energylake import schemas
from energylake.operators import reshape
from energylake.session import shared_dir, stage
from energylake.sources import tables

SCHEMA = (
    "time timestamp, site_id string, device_id string, metric_name string, "
    "metric_value double"
)


def readings(spark, *rows):
    return spark.createDataFrame(
        [(t, s, "d", "solar.generation_kw", float(v)) for t, s, v in rows], SCHEMA
    )


def content(spark, path):
    rows = spark.read.parquet(path).drop(tables.MONTH).collect()
    return sorted((r["time"], r["site_id"], r["metric_value"]) for r in rows)


JAN, JAN2 = datetime(2024, 1, 5), datetime(2024, 1, 31, 23, 59)
FEB, MAR = datetime(2024, 2, 1), datetime(2024, 3, 9)


def files(path):
    return {
        str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")
    }


def test_upsert(spark, tmp_path):
    path = tmp_path / "t"
    first = readings(spark, (JAN, "a", 1), (JAN2, "a", 2), (FEB, "a", 3), (MAR, "a", 4))
    tables.upsert(first, str(path), schemas.READING_KEY)
    march = {f: t for f, t in files(path).items() if "2024-03" in f}
    assert sorted(p.name for p in path.glob("month_start=*")) == [
        "month_start=2024-01-01",
        "month_start=2024-02-01",
        "month_start=2024-03-01",
    ]
    change = readings(spark, (JAN2, "a", 20), (FEB, "b", 30))
    for _ in range(2):  # the second time changes nothing
        tables.upsert(change, str(path), schemas.READING_KEY)
        assert content(spark, str(path)) == [
            (JAN, "a", 1.0),
            (JAN2, "a", 20.0),
            (FEB, "a", 3.0),
            (FEB, "b", 30.0),
            (MAR, "a", 4.0),
        ]
    assert march.items() <= files(path).items()
    assert not (tmp_path / "t_pending").exists()


def test_upsert_keeps_the_highest_version(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = readings(spark, (JAN, "a", 1)).withColumn("v", F.lit(1))
    newer = rows.withColumn("metric_value", F.lit(0.5)).withColumn("v", F.lit(2))
    tables.upsert(rows.union(newer), path, schemas.READING_KEY, "v")
    assert content(spark, path) == [(JAN, "a", 0.5)]


def test_upsert_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = readings(spark, (JAN, "a", 1))
    tables.upsert(rows, path, schemas.READING_KEY)
    tables.upsert(rows.where("false"), path, schemas.READING_KEY)
    assert content(spark, path) == [(JAN, "a", 1.0)]


def test_dotted_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    row = spark.createDataFrame(
        [(JAN, "a", "d", 1.5, 3)],
        "time timestamp, site_id string, device_id string, "
        "`solar.generation_kw` double, month int",
    )
    tables.upsert(row, path, schemas.KEY)
    tables.upsert(row.withColumn("month", F.lit(4)), path, schemas.KEY)
    got = tables.scan_training_data(spark, path)
    assert got.columns == row.columns
    assert got.collect()[0]["month"] == 4
    assert reshape.training_features(got).first()["solar_generation_kw"] == 1.5


class Crash(Exception):
    pass


def crash_at(monkeypatch, name, after=0):
    """Let `tables.<name>` fail, after some calls."""
    real, calls = getattr(tables, name), []

    def failing(*args):
        calls.append(args)
        if len(calls) > after:
            raise Crash(name)
        return real(*args)

    monkeypatch.setattr(tables, name, failing)


@pytest.mark.parametrize("point", ["_commit", "finish_pending"])
def test_interrupted_compaction_loses_nothing(spark, tmp_path, monkeypatch, point):
    path = str(tmp_path / "t")
    for version in (1, 2):
        rows = readings(spark, (JAN, "a", version), (FEB, "b", version))
        tables.append(rows.withColumn("v", F.lit(version)), path)
    with monkeypatch.context() as patch:
        crash_at(patch, point, after=1 if point == "finish_pending" else 0)
        with pytest.raises(Crash):
            tables.compact(spark, path, schemas.READING_KEY, "v")
    assert (tmp_path / "t_pending").exists()
    # rows that come in before the compaction is completed
    later = readings(spark, (JAN, "a", 3), (JAN, "c", 3), (FEB, "c", 3))
    tables.append(later.withColumn("v", F.lit(3)), path)
    want = [(JAN, "a", 3.0), (JAN, "c", 3.0), (FEB, "b", 2.0), (FEB, "c", 3.0)]
    view = tables.current(spark.read.parquet(path), schemas.READING_KEY, "v")
    assert sorted((r.time, r.site_id, r.metric_value) for r in view.collect()) == sorted(want)
    tables.compact(spark, path, schemas.READING_KEY, "v")
    assert content(spark, path) == sorted(want)
    assert not (tmp_path / "t_pending").exists()


def test_replacement_interrupted_between_files(spark, tmp_path):
    path = str(tmp_path / "t")
    key = schemas.READING_KEY
    tables.upsert(readings(spark, (JAN, "a", 1), (MAR, "a", 4)), path, key)
    staged = tmp_path / "t_pending"
    new = tables.with_month(readings(spark, (JAN, "a", 9), (MAR, "b", 8), (MAR, "a", 4)))
    new.coalesce(1).write.partitionBy(tables.MONTH).parquet(f"{staged}/data")
    tables._commit(spark, str(staged), tables._data_files(spark, path))
    # one file has been moved already
    (done,) = (staged / "data" / "month_start=2024-01-01").glob("*.parquet")
    done.rename(tmp_path / "t" / "month_start=2024-01-01" / done.name)
    tables.finish_pending(spark, path)
    tables.finish_pending(spark, path)
    assert content(spark, path) == [(JAN, "a", 9.0), (MAR, "a", 4.0), (MAR, "b", 8.0)]


def test_first_write_that_dies_leaves_no_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with monkeypatch.context() as patch:
        crash_at(patch, "_commit")
        with pytest.raises(Crash):
            tables.upsert(readings(spark, (JAN, "a", 1)), path, schemas.READING_KEY)
    assert not (tmp_path / "t").exists()
    tables.upsert(readings(spark, (JAN, "a", 2)), path, schemas.READING_KEY)
    assert content(spark, path) == [(JAN, "a", 2.0)]


def test_upsert_works_its_input_out_once(spark, tmp_path):
    """Random values: the stored rows are rows of one and the same evaluation."""
    path = str(tmp_path / "t")
    tables.upsert(readings(spark, (JAN, "a", 1)), path, schemas.READING_KEY)
    random = spark.range(200).select(
        (F.lit(JAN).cast("timestamp") + F.make_dt_interval(days=F.floor(F.rand() * 90).cast("int"))).alias("time"),
        F.col("id").cast("string").alias("site_id"),
        F.lit("d").alias("device_id"),
        F.lit("m").alias("metric_name"),
        F.lit(1.0).alias("metric_value"),
    )
    tables.upsert(random, path, schemas.READING_KEY)
    stored = spark.read.parquet(path)
    assert stored.count() == 201
    assert stored.where(F.trunc("time", "month") != F.col(tables.MONTH)).isEmpty()


def test_null_version_keeps_its_payload(spark):
    rows = readings(spark, (JAN, "a", 1), (FEB, "a", 2)).withColumn(
        "v", F.when(F.col("time") > F.lit(FEB), 1).cast("int")
    )
    newer = readings(spark, (FEB, "a", 3)).withColumn("v", F.lit(0))
    got = reshape.latest_per_key(rows.union(newer), schemas.READING_KEY, "v").collect()
    assert sorted((r.time, r.metric_value, r.v) for r in got) == [(JAN, 1.0, None), (FEB, 3.0, 0)]


def test_scan_folds_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch, value in ((0, 50), (1, 999), (2, 7)):
        times = (JAN, FEB) if batch < 2 else (FEB,)
        rows = readings(spark, *[(t, "a", value) for t in times])
        tables.append(rows.withColumn(tables.VERSION, F.lit(batch).cast("long")), path)
    got = tables.scan_readings(spark, path, JAN, MAR)
    assert sorted((r.time, r.metric_value) for r in got.collect()) == [(JAN, 999.0), (FEB, 7.0)]
    plan = tables.scan_readings(spark, path, FEB, MAR)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("PartitionFilters: [")[1].split("]")[0].count("month_start") >= 2


def test_append_and_compact(spark, tmp_path):
    path = str(tmp_path / "t")
    for version, value in ((1, 1), (2, 7)):
        rows = readings(spark, (JAN, "a", value), (FEB, "a", value))
        tables.append(rows.withColumn("v", F.lit(version)), path)
    assert spark.read.parquet(path).count() == 4
    view = tables.current(spark.read.parquet(path), schemas.READING_KEY, "v")
    assert [r["metric_value"] for r in view.collect()] == [7.0, 7.0]
    tables.compact(spark, path, schemas.READING_KEY, "v", [FEB.date()])
    assert spark.read.parquet(path).count() == 3
    tables.compact(spark, path, schemas.READING_KEY, "v")
    assert content(spark, path) == [(JAN, "a", 7.0), (FEB, "a", 7.0)]


def test_expire(spark, tmp_path):
    path = tmp_path / "t"
    rows = readings(spark, (JAN, "a", 1), (FEB, "a", 2), (MAR, "a", 3), (MAR, "b", 4))
    tables.upsert(rows, str(path), schemas.READING_KEY)
    tables.expire(spark, str(path), datetime(2024, 2, 7), 7)  # reaches back to Jan 31
    assert content(spark, str(path))[0] == (FEB, "a", 2.0)
    tables.expire(spark, str(path), datetime(2024, 3, 16, 12), 7)
    assert not list(path.glob("month_start=2024-0[123]*/*.parquet"))


def test_time_range_is_inclusive_and_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = readings(spark, (JAN, "a", 1), (JAN2, "a", 2), (FEB, "a", 3), (MAR, "b", 4))
    tables.append(rows, path)
    got = tables.scan_readings(spark, path, JAN2, FEB)
    assert sorted(r["metric_value"] for r in got.collect()) == [2.0, 3.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert filters.count("month_start") >= 2
    assert "GreaterThanOrEqual(time" in plan and "LessThanOrEqual(time" in plan
    assert tables.scan_readings(spark, path, JAN, MAR, "b").count() == 1
    assert tables.scan_readings(spark, path).count() == 0  # only the last 30 days


def test_training_scan_order_and_limit(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(readings(spark, (MAR, "b", 4), (JAN, "a", 1), (FEB, "a", 3)), path)
    rows = tables.scan_training_data(spark, path, limit=2).collect()
    assert [r["metric_value"] for r in rows] == [1.0, 3.0]
    assert tables.scan_training_data(spark, path).count() == 3


def test_pages_cover_everything(spark):
    rows = readings(spark, *[(JAN, f"s{i:03d}", i) for i in range(25)])
    pages = [tables.page(rows, ["time", "site_id"], n, 10).collect() for n in range(3)]
    assert [len(p) for p in pages] == [10, 10, 5]
    assert [r["metric_value"] for p in pages for r in p] == [float(i) for i in range(25)]


def test_next_pages_cover_everything(spark):
    rows = readings(spark, *[(JAN if i % 2 else FEB, f"s{i:03d}", i) for i in range(25)])
    order, after, seen = ["time", "site_id"], None, []
    while page := tables.next_page(rows, order, after, 10).collect():
        seen += [r["metric_value"] for r in page]
        after = (page[-1]["time"], page[-1]["site_id"])
    assert seen == [float(i) for i in [*range(1, 25, 2), *range(0, 25, 2)]]


def test_table_stats(spark):
    got = tables.table_stats(readings(spark, (MAR, "b", 4), (JAN, "a", 1))).first()
    assert tuple(got) == (2, JAN, MAR)
    none = tables.table_stats(readings(spark, (JAN, "a", 1)).where("false")).first()
    assert tuple(none) == (0, None, None)


def points(spark, *rows):
    return spark.createDataFrame(
        [(t, m, "d", f, 1.0) for t, m, f in rows],
        "time timestamp, measurement string, device_id string, field string, value double",
    )


def test_points_since(spark):
    rows = points(
        spark,
        (JAN, "solar", "generation_kw"),
        (FEB, "solar", "generation_kw"),
        (MAR, "solar", "generation_kw"),
        (MAR, "solar", "colour"),
        (MAR, "wind", "generation_kw"),
        (MAR, "battery", "power_kw"),
    )
    assert tables.points_since(rows, FEB).count() == 3
    first = tables.points_since(rows, JAN, limit=1).collect()
    assert {(r["measurement"], r["time"]) for r in first} == {
        ("solar", JAN),
        ("battery", MAR),
    }
    day_after = datetime(2024, 3, 10)
    assert tables.points_since(rows, now=day_after).count() == 2
    assert tables.points_since(rows).count() == 0


def test_series_limit_cuts_before_the_shuffle(spark):
    rows = tables.points_since(points(spark, (JAN, "solar", "generation_kw")), JAN, 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_points_sink(spark, tmp_path):
    path = tmp_path / "points"
    tables.write_points(points(spark, (JAN, "solar", "generation_kw")), str(path))
    assert (path / "measurement=solar" / "date=2024-01-05").exists()


def test_staging_needs_a_shared_folder(spark, tmp_path):
    df = readings(spark, (JAN, "a", 1))
    again = stage(df, "x")
    assert again.collect() == df.collect()
    assert shared_dir(spark) in again.inputFiles()[0]


def test_latest_per_key_merges_before_the_shuffle(spark):
    rows = readings(spark, (JAN, "a", 1)).withColumn("v", F.lit(1))
    latest = reshape.latest_per_key(rows, schemas.READING_KEY, "v")
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_rows_without_copies_do_not_move_whole(spark, tmp_path, monkeypatch):
    """An upsert sorts out copies of a key only where there are any."""
    calls = []
    latest = tables.latest_per_key
    monkeypatch.setattr(tables, "latest_per_key", lambda *args: calls.append(1) or latest(*args))
    path = f"{tmp_path}/t"
    key = ["time", "site_id"]
    rows = [(JAN, "a", 1.0), (JAN, None, 2.0), (FEB, "a", 3.0)]
    schema = "time timestamp, site_id string, v double"
    tables.upsert(spark.createDataFrame(rows, schema), path, key)
    assert not calls
    again = [(JAN, "a", 7.0), (JAN, "a", 5.0), (MAR, "b", 4.0)]
    tables.upsert(spark.createDataFrame(again, schema), path, key)
    got = {(r.time, r.site_id): r.v for r in tables.table(spark, path).collect()}
    assert calls and got == {(JAN, "a"): 7.0, (JAN, None): 2.0, (FEB, "a"): 3.0, (MAR, "b"): 4.0}


def test_dealt_rows_are_appended_where_they_are(spark, tmp_path):
    """No shuffle before the files: each task writes its own, in order."""
    rows = [(JAN, "b", 1.0), (JAN, "a", 2.0), (FEB, None, 3.0), (JAN2, "a", 4.0)]
    df = spark.createDataFrame(rows, "time timestamp, site_id string, v double").repartition(2, "v")
    tables.append(df, f"{tmp_path}/t", dealt=True)
    got = tables.table(spark, f"{tmp_path}/t").drop(tables.MONTH)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) >= df.rdd.getNumPartitions()
