from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from energylake import schemas
from energylake.operators import reshape
from energylake.options import SyncOptions
from energylake.sources import snapshots as snapshot_files
from energylake.sources import tables
from energylake.streaming import sync

SCHEMA = (
    "time timestamp, site_id string, device_id string, metric_name string, "
    "metric_value double"
)
START = datetime(2024, 1, 30)


def readings(spark, n=200, shift=0):
    rows = [
        (START + timedelta(hours=i), f"s{i % 2}", f"d{i % 5}", "solar.generation_kw", i + shift)
        for i in range(n)
    ]
    return spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], SCHEMA)


def run(spark, root, files_per_trigger=2, **kwargs):
    stream = (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{root}/in")
    )
    query = sync.start_readings_sync(
        stream, f"{root}/out", f"{root}/checkpoint", **kwargs
    )
    query.awaitTermination()
    return sync.synced_readings(spark, f"{root}/out")


def rows_of(df):
    return sorted(map(tuple, df.select(*schemas.READING_KEY, "metric_value").collect()))


@pytest.mark.parametrize("files", [1, 7])
def test_files_do_not_matter(spark, tmp_path, files):
    want = readings(spark)
    want.repartition(files).write.parquet(f"{tmp_path}/in")
    want.limit(50).write.mode("append").parquet(f"{tmp_path}/in")  # repeats
    assert rows_of(run(spark, tmp_path)) == rows_of(want)


def test_rerun_late_files_and_status(spark, tmp_path):
    status = f"{tmp_path}/status"
    readings(spark, 100).coalesce(1).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path, status_path=status)
    files = sorted((tmp_path / "out").rglob("*.parquet"))
    run(spark, tmp_path, status_path=status)  # nothing new: nothing is written
    assert sorted((tmp_path / "out").rglob("*.parquet")) == files

    late = readings(spark, 100, shift=1000).where("metric_value < 1010")
    older = late.withColumn("time", F.col("time") - F.expr("INTERVAL 40 DAYS"))
    late.unionByName(older).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(spark, tmp_path, status_path=status)
    values = {r[4] for r in rows_of(got)}
    assert got.count() == 110
    assert {float(i) for i in range(10)}.isdisjoint(values)  # replaced by newer ones

    facts = sync.sync_status(spark, status).first()
    assert facts["total_synced"] == 120
    assert facts["batches"] == 2
    assert facts["last_sync_count"] == 20


def test_repeated_batch_reads_the_same(spark, tmp_path):
    rows = readings(spark, 30).withColumn(sync.VERSION, F.lit(4).cast("long"))
    tables.append(rows, f"{tmp_path}/out")
    tables.append(rows, f"{tmp_path}/out")
    got = sync.synced_readings(spark, f"{tmp_path}/out")
    assert rows_of(got) == rows_of(rows)
    tables.compact(spark, f"{tmp_path}/out", schemas.READING_KEY, sync.VERSION)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30


def test_failed_batch_does_not_advance(spark, tmp_path):
    readings(spark, 20).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    broken = stream.withColumn(
        "metric_value",
        F.when(F.col("metric_value") >= 0, F.raise_error(F.lit("out of order"))),
    ).withColumn("metric_value", F.col("metric_value").cast("double"))
    with pytest.raises(Exception, match="out of order"):
        sync.start_readings_sync(
            broken, f"{tmp_path}/out", f"{tmp_path}/checkpoint"
        ).awaitTermination()
    assert run(spark, tmp_path).count() == 20


def snapshots(spark, n=6):
    def record(names, first):
        return F.struct(*[(F.col("id") + first + i).cast("double").alias(name) for i, name in enumerate(names)])

    fields = schemas.MEASUREMENT_FIELDS
    battery = F.struct(
        *[
            (F.col("id") + i).cast("int" if name == "cycles" else "double").alias(name)
            for i, name in enumerate(fields["battery"])
        ]
    )
    price = F.struct(
        F.lit(0.1).alias("price_per_kwh"),
        F.lit(0.05).alias("feed_in_tariff"),
        F.lit(10.0).alias("demand_charge"),
        F.lit("peak").alias("time_of_use_period"),
        F.lit(300.0).alias("carbon_intensity_g_kwh"),
    )
    return reshape.with_net_grid_flow(
        spark.range(n).select(
            (F.lit(START).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int") * 5)).alias("timestamp"),
            F.lit("dev").alias("device_id"),
            record(fields["solar"], 1).alias("solar"),
            battery.alias("battery"),
            record(fields["home_load"], 2).alias("home_load"),
            price.alias("grid_price"),
        )
    )


def test_snapshot_sync_and_fan_out(spark, tmp_path):
    folder = f"{tmp_path}/in"
    snapshot_files.write_snapshots(snapshots(spark), folder)
    stream = snapshot_files.stream_snapshots(spark, folder)
    sync.start_snapshot_sync(
        stream, f"{tmp_path}/readings", f"{tmp_path}/c1"
    ).awaitTermination()
    got = sync.synced_readings(spark, f"{tmp_path}/readings")
    assert got.count() == 6 * 26
    want = reshape.points_to_readings(
        reshape.snapshot_points(snapshots(spark)), "edge-gateway-site"
    )
    assert rows_of(got) == rows_of(want)

    seen = []
    sync.start_fan_out(
        snapshot_files.stream_snapshots(spark, folder),
        f"{tmp_path}/c2",
        points_path=f"{tmp_path}/points",
        json_path=f"{tmp_path}/json",
        callback=lambda batch: seen.append(batch.count()),
    ).awaitTermination()
    assert sum(seen) == 6
    points = spark.read.parquet(f"{tmp_path}/points")
    assert points.count() == 6 * 26
    tables.write_points(points.drop("date").cache(), f"{tmp_path}/points")  # a repeat
    assert sync.stored_points(spark, f"{tmp_path}/points").count() == 6 * 26
    again = snapshot_files.read_snapshots(spark, f"{tmp_path}/json")
    assert sorted(again.collect()) == sorted(snapshots(spark).collect())


def test_drop_repeats(spark, tmp_path):
    """Repeats go; late rows and newer values stay."""
    rows = readings(spark, 40)
    newer = readings(spark, 10, shift=500)
    late = readings(spark, 10).withColumn("time", F.col("time") - F.expr("INTERVAL 90 DAYS"))
    for part in (rows, rows, newer, late):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        (
            sync.drop_repeats(stream, "10 days")
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{tmp_path}/c")
            .option("path", f"{tmp_path}/out")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    want = rows.union(newer).union(late)
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(want)


def test_failed_batches_are_reported(spark, tmp_path):
    readings(spark, 20).write.parquet(f"{tmp_path}/in")
    status = f"{tmp_path}/status"
    (tmp_path / "out").write_text("in the way of the table")
    for _ in range(2):
        with pytest.raises(Exception):
            run(spark, tmp_path, 100, status_path=status)
    facts = sync.sync_status(spark, status).first()
    assert (facts["total_synced"], facts["batches"], facts["open_batches"]) == (0, 0, 1)
    assert (facts["failed"], facts["pending"]) == (40, 20)
    (tmp_path / "out").unlink()
    run(spark, tmp_path, 100, status_path=status)
    facts = sync.sync_status(spark, status).first()
    assert (facts["total_synced"], facts["batches"], facts["last_sync_count"]) == (20, 1, 20)
    assert (facts["failed"], facts["pending"]) == (40, 0)


def test_options_of_the_sync(spark, tmp_path):
    off = SyncOptions(enabled=False)
    assert sync.start_readings_sync(None, "p", "c", off) is None
    for i in range(4):
        snapshot_files.write_snapshots(snapshots(spark, 1).coalesce(1), f"{tmp_path}/in")
    stream = sync.stream_in(spark, f"{tmp_path}/in", SyncOptions(max_files_per_trigger=1))
    status = f"{tmp_path}/status"
    sync.start_snapshot_sync(
        stream, f"{tmp_path}/out", f"{tmp_path}/c", status_path=status
    ).awaitTermination()
    assert sync.sync_status(spark, status).first()["batches"] == 4
    points = reshape.snapshot_points(snapshots(spark, 50))
    options = SyncOptions(batch_size=7, lookback_hours=1)
    assert sync.pending_points(points, START, options).count() == 26 * 7
    assert sync.pending_points(points, None, options).count() == 0


def test_periodic_job(spark, tmp_path):
    readings(spark, 4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    calls = []
    sync.start_periodic(
        stream, calls.append, f"{tmp_path}/c", once=True
    ).awaitTermination()
    assert len(calls) == 1


def test_snapshots_are_spread_before_they_become_points(spark, tmp_path):
    """The shuffle of the write moves snapshots; the one of a reader keeps the metrics of a moment together."""
    plans = []

    def expand(rows):
        out = reshape.snapshot_points(rows)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return reshape.points_to_readings(out, "s")

    def write(batch, _):
        tables.append_expanded(batch, f"{tmp_path}/t", "timestamp", expand)
        tables.write_points(batch, f"{tmp_path}/p", "timestamp", reshape.snapshot_points)

    snapshot_files.write_snapshots(snapshots(spark), f"{tmp_path}/in", compression="gzip")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (
        snapshot_files.stream_snapshots(spark, f"{tmp_path}/in")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{tmp_path}/c")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    assert plans[0].index("Generate") < plans[0].index("RebalancePartitions")
    want = reshape.points_to_readings(reshape.snapshot_points(snapshots(spark)), "s")
    assert rows_of(tables.table(spark, f"{tmp_path}/t")) == rows_of(want)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 6 * 26

    rows = tables.table(spark, f"{tmp_path}/t").withColumn(tables.VERSION, F.lit(1).cast("long"))
    wide = reshape.pivot_wide(tables.folded(rows))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert wide.count() == 6
