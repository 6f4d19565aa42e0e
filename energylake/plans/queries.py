"""Registered queries, each over the whole of the tables it reads."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import cleaning, temporal
from ..operators import (
    dataset,
    forecast,
    intervals,
    metrics,
    reshape,
    runs,
    series,
    totals,
    windows,
)
from ..options import FeatureOptions, ForecastOptions, SequenceOptions
from ..session import new_path, stage
from ..sources import cursors, generations, tables
from ..sources.snapshots import (
    read_snapshots,
    snapshot_json,
    stream_snapshots,
    write_snapshots,
)
from ..streaming import changes, sync
from . import features, inputs
from .inputs import SERIES, SERIES_ORDER, load, ntz

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r4(col: Column | str) -> Column:
    return F.round(col, 4)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 4 places.

    Means of short decimals can lie half-way between two rounded values, where
    engines differ by their last bit; a shift far below the kept places puts
    them on one side.
    """
    return df.select(
        *[
            r4(F.col(name) + 1e-8).alias(name) if kind == "double" else name
            for name, kind in df.dtypes
        ]
    )


# --- points and readings ---------------------------------------------------


@query
def snapshot_explode(spark, sf_dir):
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    return reshape.snapshot_points(snapshots.drop("event_id", "site_id"))


@query
def net_grid_flow(spark, sf_dir):
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    return snapshots.select(
        "timestamp", "device_id", r4("net_grid_flow_kw").alias("net_grid_flow_kw")
    )


@query
def rounded_snapshot(spark, sf_dir):
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    rounded = reshape.rounded_snapshot(snapshots)
    return rounded.select(
        "event_id",
        "device_id",
        "solar.generation_kw",
        "solar.irradiance_w_m2",
        "battery.power_kw",
        "battery.cycles",
        "home_load.appliances_kw",
        "grid_price.price_per_kwh",
        "grid_price.time_of_use_period",
    )


@query
def readings_melt(spark, sf_dir):
    return reshape.points_to_readings(inputs.points(spark, sf_dir), F.col("site_id"))


@query
def readings_default_device(spark, sf_dir):
    rows = reshape.points_to_readings(inputs.points(spark, sf_dir), "home")
    return rows.groupBy("site_id", "device_id").agg(
        F.count(F.lit(1)).alias("readings"), F.max("time").alias("last_time")
    )


@query
def readings_try_cast(spark, sf_dir):
    rows = inputs.points(spark, sf_dir)
    return rows.select(
        "event_id", cleaning.to_number(F.col("value")).alias("metric_value")
    ).dropna(subset=["metric_value"])


@query
def snapshot_readings(spark, sf_dir):
    """Snapshots through points to readings, summed up per series and metric."""
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    rows = reshape.points_to_readings(
        reshape.snapshot_points(snapshots), F.col("site_id")
    )
    return rows.groupBy("site_id", "device_id", "metric_name").agg(
        F.count(F.lit(1)).alias("readings"),
        r4(F.sum("metric_value")).alias("total"),
    )


@query
def union_measurements(spark, sf_dir):
    wanted = ["solar", "battery", "home_load", "grid_price", "system", "wind"]
    return reshape.union_measurements(inputs.points(spark, sf_dir), wanted)


# --- scans -----------------------------------------------------------------


@query
def range_scan_site(spark, sf_dir):
    return tables.time_range(
        inputs.readings(spark, sf_dir),
        F.lit("2024-01-08").cast("timestamp_ntz"),
        F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"),
        "site-1",
    )


@query
def range_scan_ordered(spark, sf_dir):
    """The training scan: oldest rows first, cut at a limit."""
    rows = tables.time_range(
        inputs.readings(spark, sf_dir), F.lit("2024-01-08").cast("timestamp_ntz")
    )
    return rows.orderBy("time", "event_id").limit(5000)


@query
def page_offset(spark, sf_dir):
    """Third page of 1000 readings in time order."""
    return tables.page(inputs.readings(spark, sf_dir), ["time", "event_id"], 2)


@query
def page_deep(spark, sf_dir):
    """A page far from the first one, found by counts of ever narrower ranges of time."""
    rows = inputs.readings(spark, sf_dir)
    last = rows.count() * 9 // 10 // 50
    return tables.page(rows, ["time", "event_id"], last, 50, most_sorted=60)


@query
def series_cursors(spark, sf_dir):
    """Three rounds of at most 40 rows of every series, each from the mark where the last one ended."""
    root = new_path(spark, "cursors")
    rows = inputs.points(spark, sf_dir)
    for number in (1, 2, 3):

        def write(part: DataFrame, number: int = number) -> None:
            part.withColumn("round", F.lit(number)).write.mode("append").parquet(f"{root}/read")

        cursors.read_round(
            rows, f"{root}/marks", write, F.lit("2024-01-04").cast("timestamp_ntz"), 40,
            ["time", "event_id"],
        )
    return spark.read.parquet(f"{root}/read")


@query
def page_after(spark, sf_dir):
    """A page of 1000 readings from the place where the last one ended."""
    rows = inputs.readings(spark, sf_dir)
    after = (datetime(2024, 1, 12, 6, 30), -1)
    return tables.next_page(rows, ["time", "event_id"], after, 1000)


@query
def incremental_since(spark, sf_dir):
    return tables.points_since(
        inputs.points(spark, sf_dir), F.lit("2024-01-22 06:00:00").cast("timestamp_ntz")
    )


@query
def incremental_first_run(spark, sf_dir):
    """Without cursor the scan reaches back a day."""
    return tables.points_since(
        inputs.points(spark, sf_dir), now=F.lit("2024-01-31").cast("timestamp_ntz")
    )


@query
def per_series_limit(spark, sf_dir):
    return tables.points_since(
        inputs.points(spark, sf_dir),
        F.lit("2024-01-04").cast("timestamp_ntz"),
        limit=3,
        tie_break=["event_id"],
    )


@query
def table_stats(spark, sf_dir):
    return tables.table_stats(inputs.readings(spark, sf_dir))


@query
def latest_row(spark, sf_dir):
    """Earliest and latest reading of every site."""
    latest = F.struct("time", "event_id", "device_id", "metric_name", "metric_value")
    rows = inputs.readings(spark, sf_dir).groupBy("site_id")
    return rows.agg(F.min(latest).alias("a"), F.max(latest).alias("z")).select(
        "site_id",
        F.col("a.time").alias("earliest_time"),
        F.col("a.metric_value").alias("earliest_value"),
        F.col("z.time").alias("latest_time"),
        F.col("z.metric_value").alias("latest_value"),
    )


@query
def month_partition_scan(spark, sf_dir):
    path = new_path(spark, "prices")
    tables.append(inputs.price_history(spark, sf_dir), path)
    rows = tables.time_range(
        spark.read.parquet(path),
        F.lit("1996-02-10").cast("timestamp_ntz"),
        F.lit("1998-11-20").cast("timestamp_ntz"),
    )
    month = F.date_format(tables.MONTH, "yyyy-MM").alias("month")
    return rows.groupBy(month, "site_id").agg(
        F.count(F.lit(1)).alias("readings"), r4(F.sum("metric_value")).alias("total")
    )


@query
def retention_compaction(spark, sf_dir):
    """A table after rows older than 900 days before its end have been removed."""
    path = new_path(spark, "prices")
    tables.append(inputs.price_history(spark, sf_dir), path)
    tables.expire(spark, path, datetime(2000, 1, 10), 900)
    month = F.date_format(tables.MONTH, "yyyy-MM").alias("month")
    return (
        spark.read.parquet(path)
        .groupBy(month)
        .agg(F.count(F.lit(1)).alias("readings"), F.min("time").alias("first_time"))
    )


@query
def points_sink(spark, sf_dir):
    """Points stored by measurement and day; one measurement read back."""
    path = new_path(spark, "points")
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    tables.write_points(reshape.snapshot_points(snapshots), path)
    battery = spark.read.parquet(path).where("measurement = 'battery'")
    return battery.groupBy("device_id", "field").agg(
        F.count(F.lit(1)).alias("points"), r4(F.sum("value")).alias("total")
    )


@query
def snapshot_round_trip(spark, sf_dir):
    """Snapshots written as JSON lines and read back; the net flow is derived."""
    path = new_path(spark, "json")
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    write_snapshots(
        snapshots.withColumn("timestamp", F.col("timestamp").cast("timestamp")), path
    )
    return read_snapshots(spark, path).select(
        ntz(F.col("timestamp")).alias("timestamp"),
        "device_id",
        "battery.soc_percent",
        "battery.cycles",
        "home_load.appliances_kw",
        "grid_price.time_of_use_period",
        F.round(
            F.col("net_grid_flow_kw")
            - F.col("home_load.total_load_kw")
            + F.col("solar.generation_kw"),
            3,
        ).alias("battery_kw"),
    )


@query
def retention_filter(spark, sf_dir):
    return tables.not_expired(
        inputs.readings(spark, sf_dir), F.lit("2024-01-31").cast("timestamp_ntz"), 7
    )


# --- duplicates, pivot, upsert ---------------------------------------------


@query
def duplicate_groups(spark, sf_dir):
    return reshape.duplicate_groups(inputs.versions(spark, sf_dir))


@query
def duplicate_count(spark, sf_dir):
    groups = reshape.duplicate_groups(inputs.versions(spark, sf_dir))
    return groups.agg(
        F.count(F.lit(1)).alias("duplicated_keys"), F.sum("copies").alias("copies")
    )


@query
def pivot_wide(spark, sf_dir):
    return reshape.pivot_wide(
        inputs.versions(spark, sf_dir),
        list(inputs.METRIC_OF_EVENT.values()),
        order_col="version",
    )


@query
def pivot_snapshots(spark, sf_dir):
    """All 18 metrics wide again, out of the 26 long fields of each snapshot."""
    return reshape.pivot_wide(_snapshot_readings(spark, sf_dir))


@query
def upsert_latest(spark, sf_dir):
    path = new_path(spark, "upsert")
    first = inputs.readings(spark, sf_dir).withColumn("version", F.lit(1))
    tables.upsert(first, path, schemas.READING_KEY, "version")
    tables.upsert(inputs.newer(first), path, schemas.READING_KEY, "version")
    return spark.read.parquet(path).select(
        *[ntz(F.col(c)).alias(c) if c == "time" else c for c in schemas.READING_KEY],
        "metric_value",
        "version",
    )


@query
def append_and_compact(spark, sf_dir):
    """Append-only versions, compacted to the latest of every key."""
    path = new_path(spark, "versions")
    first = inputs.readings(spark, sf_dir).withColumn("version", F.lit(1))
    tables.append(first, path)
    tables.append(inputs.newer(first), path)
    tables.compact(spark, path, schemas.READING_KEY, "version")
    return spark.read.parquet(path).select(
        *schemas.READING_KEY, "metric_value", "version"
    )


# --- projections -----------------------------------------------------------


@query
def null_clean(spark, sf_dir):
    value, k = F.col("metric_value"), F.col("event_id") % 5
    broken = (
        F.when(k == 0, F.lit(float("nan")))
        .when(k == 1, F.lit(float("inf")))
        .when(k == 2, F.lit(float("-inf")))
        .otherwise(value)
    )
    rows = inputs.readings(spark, sf_dir).withColumn("metric_value", broken)
    return cleaning.nan_to_null(rows).select("event_id", "metric_value")


@query
def schema_projection(spark, sf_dir):
    """Wide rows clamped to the declared columns of the training table."""
    wide = inputs.wide_readings(spark, sf_dir).withColumn("extra", F.lit(1))
    return reshape.project_declared(wide, schemas.feature_columns())


@query
def training_view(spark, sf_dir):
    """The training table seen under column-safe names."""
    path = new_path(spark, "training")
    wide = inputs.wide_readings(spark, sf_dir)
    tables.upsert(
        reshape.project_declared(wide, schemas.feature_columns()), path, schemas.KEY
    )
    tables.register_training_view(spark, path)
    return spark.sql(
        """
        SELECT site_id,
               count(solar_generation_kw) AS solar_rows,
               round(avg(solar_generation_kw), 4) AS mean_solar_kw,
               round(avg(home_load_total_load_kw), 4) AS mean_load_kw,
               max(grid_price_price_per_kwh) AS top_price
        FROM training_features GROUP BY site_id
        """
    )


@query
def feature_requirements(spark, sf_dir):
    """Which declared metrics the wide rows have, and whether asking for the others is refused."""
    rows = inputs.readings(spark, sf_dir)
    # metric names: a bounded catalogue
    found = sorted(r[0] for r in rows.select("metric_name").distinct().collect())
    wide = reshape.pivot_wide(rows, found, "event_id")
    names = [schemas.flat(m) for m in schemas.METRICS]
    available, _ = reshape.select_features(wide, names)
    count = wide.count()

    def refused(name: str) -> bool:
        try:
            reshape.require_columns(wide, ["time", name])
        except ValueError:
            return True
        return False

    facts = [(name, name in available, refused(name), count) for name in names]
    return spark.createDataFrame(facts, "feature string, available boolean, refused boolean, wide_rows long")


@query
def iso_time(spark, sf_dir):
    time = F.col("ts")
    return load(spark, sf_dir, "events").select(
        "event_id",
        cleaning.iso_seconds(time).alias("iso_time"),
        cleaning.rfc3339(time).alias("rfc3339_time"),
    )


@query
def parse_time(spark, sf_dir):
    """ISO text with Z or offset to UTC; other text gives null."""
    text = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(
            F.col("event_id") % 3 == 1,
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-08:00'"),
        )
        .otherwise(F.col("props"))
    )
    return load(spark, sf_dir, "events").select(
        "event_id", ntz(cleaning.parse_time(text)).alias("parsed_time")
    )


# --- calendar and time of use ----------------------------------------------


@query
def temporal_features(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return events.select(
        "event_id", *[c.alias(n) for n, c in temporal.calendar(F.col("ts")).items()]
    )


@query
def cyclic_features(spark, sf_dir):
    rows = temporal.with_temporal_features(load(spark, sf_dir, "events"), "ts")
    return rows.select(
        "event_id",
        *[r4(c).alias(c) for c in ("hour_sin", "hour_cos", "day_sin", "day_cos")],
    )


@query
def tou_onehot(spark, sf_dir):
    rows = inputs.snapshots(spark, sf_dir).select(
        "event_id",
        F.when(
            F.col("event_id") % 4 != 0, F.col("grid_price.time_of_use_period")
        ).alias("grid_price_time_of_use_period"),
    )
    return temporal.with_tou_features(rows)


@query
def tou_from_hour(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(
        "event_id", F.hour("ts").alias("hour_of_day")
    )
    return temporal.with_tou_features(rows)


@query
def tou_schedule_join(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "ts")
    labelled = temporal.label_by_schedule(
        rows, temporal.schedule_table(spark), F.hour("ts")
    )
    return labelled.select("event_id", "period")


@query
def grid_align(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(
        ntz(temporal.align(F.col("ts"), 300)).alias("slot"), "value"
    )
    return rows.groupBy("slot").agg(
        F.count(F.lit(1)).alias("events"), F.max("value").alias("top_value")
    )


@query
def time_spine(spark, sf_dir):
    spine = temporal.spine_of(load(spark, sf_dir, "events"), "ts", 5)
    return spine.select(ntz(F.col("time")).alias("time"))


# --- series windows --------------------------------------------------------

WINDOW = {"metric_value": ("rolling_avg", "rolling_std")}


@query
def rolling_mean_std(spark, sf_dir):
    rows = windows.rolling_mean_std(
        inputs.readings(spark, sf_dir), WINDOW, 12, SERIES, SERIES_ORDER
    )
    return rows.select(
        "event_id", "device_id", r4("rolling_avg").alias("rolling_avg"),
        r4("rolling_std").alias("rolling_std"),
    )


@query
def rolling_long_window(spark, sf_dir):
    """A window of many rows, per site."""
    rows = windows.rolling_mean_std(
        inputs.readings(spark, sf_dir), WINDOW, 300, ["site_id"], SERIES_ORDER
    )
    return rows.select(
        "event_id", "site_id", r4("rolling_avg").alias("rolling_avg"),
        r4("rolling_std").alias("rolling_std"),
    )


@query
def rolling_with_nulls(spark, sf_dir):
    """A window lacking a value gives null: one metric among the rows of all."""
    rows = windows.rolling_mean_std(
        inputs.wide_readings(spark, sf_dir),
        {"solar_generation_kw": ("rolling_avg", "rolling_std")},
        2,
        SERIES,
        ["time"],
    )
    return rows.select(
        "time", "device_id", r4("rolling_avg").alias("rolling_avg"),
        r4("rolling_std").alias("rolling_std"),
    )


@query
def lag_features(spark, sf_dir):
    rows = windows.lag_columns(
        inputs.readings(spark, sf_dir),
        {
            "lag_1": ("metric_value", 1),
            "lag_1h": ("metric_value", 12),
            "lag_0": ("metric_value", 0),
        },
        SERIES,
        SERIES_ORDER,
    )
    return rows.select("event_id", "device_id", "lag_1", "lag_1h", "lag_0")


@query
def rolling_cut(spark, sf_dir):
    """Rolling windows over series that are cut into chunks of few rows."""
    rows = windows.rolling_mean_std(
        inputs.readings(spark, sf_dir), WINDOW, 30, ["site_id"], SERIES_ORDER, max_rows=100
    )
    return rows.select(
        "event_id", "site_id", r4("rolling_avg").alias("rolling_avg"),
        r4("rolling_std").alias("rolling_std"),
    )


@query
def lag_lead_cut(spark, sf_dir):
    """Lags and leads over cut series; series without name are a series too."""
    rows = inputs.readings(spark, sf_dir).withColumn(
        "site_id", F.when(F.col("site_id") != "site-2", F.col("site_id"))
    )
    rows = windows.lag_columns(
        rows, {"lag_7": ("metric_value", 7)}, ["site_id"], SERIES_ORDER, max_rows=100
    )
    rows = windows.lead_column(
        rows, "metric_value", 9, "lead_9", ["site_id"], SERIES_ORDER, max_rows=100
    )
    return rows.select("event_id", "site_id", "lag_7", "lead_9")


@query
def split_cut(spark, sf_dir):
    rows = dataset.chrono_split(
        inputs.readings(spark, sf_dir), 0.2, 0.15, [], SERIES_ORDER, max_rows=100
    )
    return rows.select("event_id", "split")


@query
def running_total_cut(spark, sf_dir):
    rows = series.running_total(
        inputs.readings(spark, sf_dir), ["site_id"], SERIES_ORDER, "metric_value", "total",
        max_rows=100,
    )
    return rows.select("event_id", "site_id", r4(F.col("total") + 1e-8).alias("total"))


@query
def first_rows_cut(spark, sf_dir):
    """More first rows of each series than Spark cuts before a shuffle by itself."""
    rows = windows.first_n_per_series(
        inputs.readings(spark, sf_dir), ["site_id"], SERIES_ORDER, 1200
    )
    return rows.select("event_id", "site_id")


@query
def interval_classes(spark, sf_dir):
    """Windows, lags and labels in the rows of each device's own sampling interval.

    Six hours, one hour back and two hours ahead: the device with a sample every two hours
    has no row an hour back, and its label is the next row.
    """
    rows = inputs.clocked(spark, sf_dir)
    facts = windows.series_facts(rows, SERIES, SERIES_ORDER)

    def add(part: DataFrame, minutes: int, longest: int) -> DataFrame:
        n = windows.horizon_samples(6, minutes)
        part = windows.rolling_mean_std(part, WINDOW, n, SERIES, SERIES_ORDER)
        back = windows.samples_per_hour(minutes)
        return windows.lag_columns(
            part, {"lag_1h": ("metric_value", back)}, SERIES, SERIES_ORDER
        )

    built = windows.by_interval_class(rows, facts, SERIES, add)
    labelled = dataset.lead_by_class(
        built, "metric_value", 2, keys=SERIES, order=SERIES_ORDER
    )
    return _rounded(
        labelled.select(
            "event_id", "device_id", "rolling_avg", "rolling_std", "lag_1h", "label"
        )
    )


@query
def exact_intervals(spark, sf_dir):
    """Windows of 20 minutes, values 10 minutes back and 15 ahead, in rows of each device's own interval.

    No interval is a usual one; the device with a sample every 45 minutes has no row 10 minutes back.
    """
    rows = inputs.unusual(spark, sf_dir)
    keys, order = ["device_id"], ["time"]
    facts = stage(intervals.series_intervals(rows, keys, order), "facts")
    micros = F.col("interval_micros")

    def per(minutes: int) -> Column:
        return F.bround(minutes * 60_000_000 / micros).cast("long")

    one = F.lit(1).cast("long")
    rows, widest, longest = intervals.with_row_counts(
        rows, facts, keys, _micros=micros,
        window_rows=F.greatest(one, per(20)), _back=per(10), _ahead=F.greatest(one, per(15)),
    )
    built = intervals.rolling_mean_std(
        rows, WINDOW, "window_rows", widest["window_rows"], keys, order, longest=longest
    )
    built = intervals.lag_columns(
        built, {"lagged": ("metric_value", "_back")}, widest["_back"], keys, order, longest=longest
    )
    built = intervals.lead_column(
        built, "metric_value", "_ahead", widest["_ahead"], "label", keys, order, longest=longest
    )
    values = built.select("event_id", "device_id", "rolling_avg", "rolling_std", "lagged", "label")
    return _rounded(values).join(
        built.select("event_id", F.col("_micros").alias("interval_micros"), "window_rows"), "event_id"
    )


@query
def median_by_series(spark, sf_dir):
    """Exact median interval of every device, in microseconds."""
    rows = inputs.readings(spark, sf_dir)
    return intervals.series_intervals(rows, SERIES, SERIES_ORDER)


@query
def interarrival(spark, sf_dir):
    rows = windows.with_gaps(inputs.readings(spark, sf_dir), SERIES, SERIES_ORDER)
    return rows.select("event_id", "device_id", "gap_micros")


@query
def median_interval(spark, sf_dir):
    gaps = windows.with_gaps(inputs.readings(spark, sf_dir), SERIES, SERIES_ORDER)
    return windows.median_gap(gaps)


@query
def lead_target(spark, sf_dir):
    rows = dataset.lead_target(
        inputs.readings(spark, sf_dir), "metric_value", 24, ["metric_value"],
        SERIES, SERIES_ORDER,
    )
    return rows.select("event_id", "device_id", "metric_value", "label")


@query
def chrono_split(spark, sf_dir):
    rows = dataset.chrono_split(
        inputs.readings(spark, sf_dir), 0.2, None, SERIES, SERIES_ORDER
    )
    return rows.select("event_id", "split")


@query
def global_split(spark, sf_dir):
    """All series together, split by time."""
    rows = dataset.chrono_split(
        inputs.readings(spark, sf_dir), 0.2, 0.15, [], SERIES_ORDER
    )
    return rows.select("event_id", "split")


@query
def nested_split(spark, sf_dir):
    rows = dataset.chrono_split(
        inputs.readings(spark, sf_dir), 0.2, 0.15, SERIES, SERIES_ORDER
    )
    return rows.select("event_id", "device_id", "split")


@query
def split_counts(spark, sf_dir):
    rows = dataset.chrono_split(
        inputs.readings(spark, sf_dir), 0.2, 0.15, SERIES, SERIES_ORDER
    )
    return dataset.split_counts(rows)


def _run_facts(runs: DataFrame, *extra: str) -> DataFrame:
    first, last = F.col("x")[0], F.element_at("x", -1)
    total = F.aggregate("x", F.lit(0.0), lambda a, row: a + row[0])
    return runs.select(
        "device_id",
        "time",
        F.size("x").alias("run_rows"),
        r4(first[0]).alias("first_value"),
        r4(last[0]).alias("last_value"),
        r4(last[1]).alias("last_hour"),
        F.round(total, 2).alias("value_sum"),
        *extra,
    )


def _run_input(spark, sf_dir) -> DataFrame:
    return inputs.readings(spark, sf_dir).withColumn(
        "hour", F.hour("time").cast("double")
    )


@query
def sequences(spark, sf_dir):
    runs = dataset.sequences(
        _run_input(spark, sf_dir), ["metric_value", "hour"], "metric_value", 6, 3,
        SERIES, SERIES_ORDER,
    )
    return _run_facts(runs, "y")


@query
def nan_targets(spark, sf_dir):
    """Runs whose target is missing or no number are left out."""
    rows = _run_input(spark, sf_dir).withColumn(
        "target",
        F.when(F.col("event_id") % 9 == 0, float("nan")).when(
            F.col("event_id") % 9 != 4, F.col("metric_value")
        ),
    )
    runs = dataset.sequences(
        rows, ["metric_value", "hour"], "target", 6, 3, SERIES, SERIES_ORDER
    )
    return _run_facts(runs, "y")


@query
def strided_sequences(spark, sf_dir):
    runs = dataset.sequences(
        _run_input(spark, sf_dir), ["metric_value", "hour"], "metric_value", 8, 2,
        SERIES, SERIES_ORDER, stride=4,
    )
    return _run_facts(runs, "y")


@query
def padded_sequences(spark, sf_dir):
    runs = dataset.padded_sequences(
        _run_input(spark, sf_dir), ["metric_value", "hour"], 64, SERIES, SERIES_ORDER
    )
    return _run_facts(runs)


@query
def scale_features(spark, sf_dir):
    rows = _run_input(spark, sf_dir).withColumn("constant", F.lit(3.0))
    names = ["metric_value", "hour", "constant"]
    scaled = dataset.Scaler.fit(rows, names).transform(rows)
    return scaled.select("event_id", *[r4(n).alias(n) for n in names])


# --- metrics ---------------------------------------------------------------


def _metrics(spark, sf_dir) -> DataFrame:
    pairs = inputs.forecasts(spark, sf_dir)
    return metrics.forecast_metrics(
        pairs, "actual", "predicted", 10.0, ["o_orderpriority"]
    ).withColumnRenamed("o_orderpriority", "target")


@query
def forecast_metrics(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir))


@query
def forecast_metrics_total(spark, sf_dir):
    pairs = inputs.forecasts(spark, sf_dir)
    return _rounded(metrics.forecast_metrics(pairs, "actual", "predicted", 100.0))


@query
def zero_actuals(spark, sf_dir):
    """Percentage errors leave out actual values of zero."""
    pairs = inputs.forecasts(spark, sf_dir).withColumn(
        "actual", F.when(F.col("o_orderkey") % 7 != 0, F.col("actual")).otherwise(0.0)
    )
    return _rounded(metrics.forecast_metrics(pairs, "actual", "predicted", 100.0))


@query
def compare_models(spark, sf_dir):
    """The customer's last price against a shrunken form of it, where both exist.

    The shrunken form leaves out one priority, so that the comparison has a target that only one side knows.
    """
    pairs = inputs.forecasts(spark, sf_dir)
    shrunk = pairs.where("o_orderpriority <> '5-LOW'").withColumn(
        "predicted", F.col("predicted") * 0.5 + 125000.0
    )
    candidate = metrics.forecast_metrics(
        shrunk, "actual", "predicted", 5.0, ["o_orderpriority"]
    ).withColumnRenamed("o_orderpriority", "target")
    return _rounded(
        metrics.compare_forecasts(candidate, _metrics(spark, sf_dir), 40.0)
    )


@query
def best_epoch(spark, sf_dir):
    """Days as epochs, with daily means as losses."""
    day = F.dayofmonth("ts")
    losses = (
        load(spark, sf_dir, "events")
        .groupBy(day.alias("epoch"))
        .agg(
            F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias(
                "train_loss"
            ),
            F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias(
                "validation_loss"
            ),
        )
    )
    return metrics.best_epoch(losses)


# --- parts, durations, running totals --------------------------------------

PARTS = ["hvac_kw", "appliances_kw", "lighting_kw", "ev_charging_kw", "other_kw"]


@query
def load_quality(spark, sf_dir):
    """How often the parts of a load add up to its total."""
    total = F.col("home_load.total_load_kw") + F.when(
        F.col("event_id") % 11 == 0, 0.01
    ).otherwise(0.0)
    fits = totals.parts_match_total([F.col(f"home_load.{n}") for n in PARTS], total)
    rows = inputs.snapshots(spark, sf_dir).select("site_id", fits.alias("fits"))
    return rows.groupBy("site_id").agg(
        F.count_if("fits").alias("consistent"), F.count(F.lit(1)).alias("rows")
    )


@query
def sample_duration(spark, sf_dir):
    rows = totals.with_duration_hours(
        inputs.readings(spark, sf_dir), SERIES, SERIES_ORDER
    )
    return rows.select("event_id", "device_id", r4("duration_hours").alias("hours"))


@query
def throughput_cycles(spark, sf_dir):
    rows = inputs.snapshots(spark, sf_dir).select(
        F.col("timestamp").alias("time"),
        "site_id",
        "device_id",
        "event_id",
        F.col("battery.power_kw").alias("power_kw"),
        F.col("battery.capacity_kwh").alias("capacity_kwh"),
    )
    rows = totals.with_duration_hours(rows, SERIES, SERIES_ORDER)
    rows = totals.running_energy(rows, "power_kw", keys=SERIES, order=SERIES_ORDER)
    cycles = F.floor(F.col("throughput_kwh") / F.col("capacity_kwh")).cast("long")
    return rows.select(
        "event_id",
        r4(F.col("throughput_kwh") + 1e-8).alias("throughput_kwh"),
        cycles.alias("cycles"),
    )


# --- whole jobs ------------------------------------------------------------


def _snapshot_readings(spark, sf_dir) -> DataFrame:
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    return reshape.points_to_readings(
        reshape.snapshot_points(snapshots), F.col("site_id")
    )


#: the SQL of the first feature queries works out intervals by classes
CLASSED = FeatureOptions(intervals="classes")


@query
def feature_build(spark, sf_dir):
    """Snapshots to points, readings, wide rows and features."""
    built = features.build_features(_snapshot_readings(spark, sf_dir), CLASSED)
    return _rounded(reshape.training_features(features.training_table(built)))


@query
def feature_build_exact(spark, sf_dir):
    """Features by each device's exact median interval, with a window of one day."""
    options = FeatureOptions(rolling_window_days=1)
    built = features.build_features(_snapshot_readings(spark, sf_dir), options)
    return _rounded(
        reshape.training_features(features.training_table(built, options))
    )


@query
def feature_build_mixed(spark, sf_dir):
    """The same with all devices as one series and a one-day window."""
    options = FeatureOptions(rolling_window_days=1, partition_cols=[], intervals="classes")
    built = features.build_features(_snapshot_readings(spark, sf_dir), options)
    return _rounded(
        reshape.training_features(features.training_table(built, options))
    )


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time", F.col("time").cast("timestamp"))


def _synced(spark, sf_dir, root: str, status: str | None = None) -> None:
    """Readings that arrive as files, some of them twice; later files hold newer values."""
    rows = _timed(inputs.readings(spark, sf_dir))
    newer = inputs.newer(rows).drop("version")
    schema = rows.drop("event_id").schema
    first = rows.repartition(6, "event_id")
    for part in (first, rows.where("site_id = 'site-1'"), newer):
        part.drop("event_id").write.mode("append").parquet(f"{root}/in")
        stream = (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", 3)
            .parquet(f"{root}/in")
        )
        sync.start_readings_sync(
            stream, f"{root}/readings", f"{root}/checkpoint", status_path=status
        ).awaitTermination()


@query
def stream_sync_upsert(spark, sf_dir):
    """Readings synced from files; the last value of each is read."""
    root = new_path(spark, "sync")
    _synced(spark, sf_dir, root)
    rows = sync.synced_readings(spark, f"{root}/readings")
    return rows.withColumn("time", ntz(F.col("time")))


@query
def sync_then_features(spark, sf_dir):
    """Updated readings reach the wide rows and their lags."""
    root = new_path(spark, "sync")
    _synced(spark, sf_dir, root)
    rows = tables.scan_readings(
        spark, f"{root}/readings", datetime(2024, 1, 1), datetime(2024, 3, 1)
    )
    wide = reshape.pivot_wide(rows, list(inputs.METRIC_OF_EVENT.values()))
    lagged = windows.lag_columns(
        wide, {"load_lag_1": ("home_load_total_load_kw", 1)}, SERIES, ["time"]
    )
    return lagged.select(
        ntz(F.col("time")).alias("time"),
        "site_id",
        "device_id",
        "solar_generation_kw",
        "home_load_total_load_kw",
        "load_lag_1",
    )


@query
def sync_status(spark, sf_dir):
    """Totals of a sync whose first attempts fail, as their table cannot be written."""
    root = new_path(spark, "status")
    rows = _timed(inputs.readings(spark, sf_dir).drop("event_id"))
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    unwritable = stream.withColumn("since", F.make_interval(days=F.lit(1)))
    for readings in (unwritable, unwritable, stream):
        try:
            sync.start_readings_sync(
                readings, f"{root}/out", f"{root}/checkpoint", status_path=f"{root}/status"
            ).awaitTermination()
        except StreamingQueryException:
            pass
    status = sync.sync_status(spark, f"{root}/status")
    return status.withColumn("last_sync_time", ntz(F.col("last_sync_time")))


@query
def fan_out(spark, sf_dir):
    """Snapshots sent to a table of points and to JSON lines; both read back."""
    root = new_path(spark, "fan")
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    write_snapshots(
        snapshots.withColumn("timestamp", F.col("timestamp").cast("timestamp")),
        f"{root}/in",
        compression="gzip",
    )
    sync.start_fan_out(
        stream_snapshots(spark, f"{root}/in"),
        f"{root}/checkpoint",
        points_path=f"{root}/points",
        json_path=f"{root}/json",
        json_compression="gzip",
    ).awaitTermination()
    sent = read_snapshots(spark, f"{root}/json").select(
        F.lit("snapshots").alias("sink"), "device_id"
    )
    stored = sync.stored_points(spark, f"{root}/points").select(
        F.concat_ws(".", "measurement", "field").alias("sink"), "device_id"
    )
    return sent.union(stored).groupBy("sink", "device_id").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def stream_drop_repeats(spark, sf_dir):
    """Repeated readings suppressed inside the stream; newer values are no repeats."""
    root = new_path(spark, "repeats")
    rows = _timed(inputs.readings(spark, sf_dir))
    newer = inputs.newer(rows).drop("version")
    rows, newer = rows.drop("event_id"), newer.drop("event_id")
    for part in (rows, rows, newer):
        part.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    (
        sync.drop_repeats(stream, "1 day")
        .writeStream.option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/out", format="parquet")
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/out").withColumn("time", ntz(F.col("time")))


@query
def changes_only(spark, sf_dir):
    """Readings whose value differs from the last one: first, changed, back again, and repeated.

    Every tenth reading goes from its value to another one and back, each step in files of its own.
    """
    root = new_path(spark, "changes")
    rows = _timed(inputs.readings(spark, sf_dir))
    changed = inputs.newer(rows).drop("version")
    schema = rows.withColumn("step", F.lit(0)).schema
    for step, part in enumerate((rows, changed, rows, rows)):
        part.withColumn("step", F.lit(step)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        found = changes.changes_only(stream, schemas.READING_KEY, "metric_value", ["step", "event_id"])
        changes.start(found, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").withColumn("time", ntz(F.col("time")))


@query
def two_checkpoints(spark, sf_dir):
    """A table written through one checkpoint, then through a new one; the later one counts.

    The first one brings raised values in a second batch, so its batch number is the higher one.
    """
    root = new_path(spark, "epochs")
    rows = _timed(inputs.readings(spark, sf_dir))
    once_more = rows.where("event_id % 20 = 0").withColumn("metric_value", F.col("metric_value") + 5)
    schema = rows.drop("event_id").schema
    steps = [
        ("first", rows), ("first", inputs.newer(rows).drop("version")), ("second", once_more),
    ]
    for name, part in steps:
        part.drop("event_id").write.mode("append").parquet(f"{root}/{name}")
        sync.start_readings_sync(
            spark.readStream.schema(schema).parquet(f"{root}/{name}"),
            f"{root}/readings",
            f"{root}/checkpoint-{name}",
        ).awaitTermination()
    synced = sync.synced_readings(spark, f"{root}/readings")
    return synced.withColumn("time", ntz(F.col("time")))


@query
def compact_ties(spark, sf_dir):
    """Several values of a reading in one batch: the last one counts, before compaction and after."""
    root = new_path(spark, "ties")
    rows = _timed(inputs.readings(spark, sf_dir))
    parts = [
        rows.withColumn("step", F.lit(0)),
        rows.withColumn("metric_value", F.col("metric_value") - 1).withColumn("step", F.lit(1)),
    ]
    together = parts[0].unionByName(parts[1]).withColumn(
        "arrived", F.timestamp_seconds(F.col("step") * 1_000_000_000 + F.col("event_id"))
    )
    together = together.drop("event_id", "step")
    together.write.parquet(f"{root}/in")
    sync.start_readings_sync(
        spark.readStream.schema(together.schema).parquet(f"{root}/in"),
        f"{root}/readings", f"{root}/checkpoint", arrival="arrived",
    ).awaitTermination()
    before = stage(sync.synced_readings(spark, f"{root}/readings"), "before")
    tables.compact(spark, f"{root}/readings", schemas.READING_KEY, tables.VERSION)
    after = sync.synced_readings(spark, f"{root}/readings")
    both = before.withColumn("moment", F.lit("before")).unionByName(
        after.withColumn("moment", F.lit("after"))
    )
    return both.withColumn("time", ntz(F.col("time")))


@query
def interrupted_replacement(spark, sf_dir):
    """What readers see at each step at which an upsert can stop."""
    root = new_path(spark, "interrupted")
    path = f"{root}/readings"
    first = _timed(inputs.readings(spark, sf_dir)).withColumn("version", F.lit(1))
    tables.upsert(first, path, schemas.READING_KEY, "version")
    seen = []

    def look(moment: str) -> None:
        rows = tables.table(spark, path).drop(tables.MONTH)
        seen.append(stage(rows.withColumn("moment", F.lit(moment)), f"seen-{moment}"))

    changed = tables.with_month(inputs.newer(tables.table(spark, path).drop(tables.MONTH)))
    old = tables.table(spark, path).inputFiles()
    kept = generations.read_files(spark, path, old).join(
        changed.select(*schemas.READING_KEY), schemas.READING_KEY, "left_anti"
    )
    kept.unionByName(changed).write.partitionBy(tables.MONTH).parquet(
        f"{generations.pending(path)}/data"
    )
    look("written")
    generations.commit(spark, path, old)
    look("committed")
    journal = generations.read_journal(spark, path)
    generations.move_in(spark, path, journal)
    look("moved")
    generations.switch(spark, path)
    look("switched")
    generations.drop_old(spark, path, journal)
    look("dropped")
    tables.finish_pending(spark, path)
    look("finished")
    out = reduce(DataFrame.unionByName, seen)
    return out.withColumn("time", ntz(F.col("time")))


SPAN = dict(start=datetime(2024, 1, 1), end=datetime(2024, 2, 1))


def _stored_snapshots(spark, sf_dir, root: str) -> None:
    # the events are dealt to tasks before they become readings
    tables.append(_timed(_snapshot_readings(spark, sf_dir)), f"{root}/readings", dealt=True)


def _training_stats(spark, root: str) -> DataFrame:
    stats = tables.table_stats(spark.read.parquet(f"{root}/training"))
    return stats.select(
        "total_records",
        ntz(F.col("earliest_time")).alias("earliest_time"),
        ntz(F.col("latest_time")).alias("latest_time"),
    )


@query
def training_table_stats(spark, sf_dir):
    """The feature job from stored readings to the stored training table."""
    root = new_path(spark, "job")
    _stored_snapshots(spark, sf_dir, root)
    features.run(spark, f"{root}/readings", f"{root}/training", CLASSED, **SPAN)
    return _training_stats(spark, root)


@query
def run_summary(spark, sf_dir):
    """What the feature job reports of a run."""
    root = new_path(spark, "job")
    _stored_snapshots(spark, sf_dir, root)
    done = features.run(spark, f"{root}/readings", f"{root}/training", CLASSED, **SPAN)
    names = ("status", "records_processed", "records_stored", "features_count")
    return spark.createDataFrame(
        [tuple(done[n] for n in names)],
        "status string, records_processed long, records_stored long, features_count int",
    )


@query
def periodic_features(spark, sf_dir):
    """The feature job run whenever a stream brings readings, here twice.

    The second run finds the same readings stored, and replaces what the first has built.
    """
    root = new_path(spark, "periodic")
    _stored_snapshots(spark, sf_dir, root)
    rows = _timed(_snapshot_readings(spark, sf_dir))
    for half in (0, 1):
        part = rows.where(F.pmod(F.xxhash64("time"), F.lit(2)) == half)
        part.write.mode("append").parquet(f"{root}/arrived")
        sync.start_periodic(
            spark.readStream.schema(rows.schema).parquet(f"{root}/arrived"),
            lambda session: features.run(
                session, f"{root}/readings", f"{root}/training", CLASSED, **SPAN
            ),
            f"{root}/checkpoint",
            once=True,
        ).awaitTermination()
    return _training_stats(spark, root)


@query
def incremental_features(spark, sf_dir):
    """The feature job for changed series only: first most devices, then new ones and some that come again."""
    root = new_path(spark, "incremental")
    rows = _timed(_snapshot_readings(spark, sf_dir))
    device = F.col("device_id").cast("int") % 5
    options = FeatureOptions(rolling_window_days=1)
    built = []
    for part in (rows.where(device != 0), rows.where(device <= 1), None):
        if part is not None:
            part.write.mode("append").parquet(f"{root}/in")
        sync.start_readings_sync(
            spark.readStream.schema(rows.schema).parquet(f"{root}/in"),
            f"{root}/readings", f"{root}/checkpoint",
        ).awaitTermination()
        done = features.run_changed(
            spark, f"{root}/readings", f"{root}/training", f"{root}/state", options, **SPAN
        )
        built.append(done["series_built"])
    stats = tables.table_stats(tables.table(spark, f"{root}/training"))
    return stats.select(
        "total_records",
        ntz(F.col("earliest_time")).alias("earliest_time"),
        ntz(F.col("latest_time")).alias("latest_time"),
        *[F.lit(n).cast("long").alias(f"series_{i}") for i, n in enumerate(built, 1)],
    )


@query
def stream_snapshot_sync(spark, sf_dir):
    """Snapshots written as JSON lines, read as a stream, synced to readings."""
    root = new_path(spark, "snapshots")
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir))
    write_snapshots(
        snapshots.withColumn("timestamp", F.col("timestamp").cast("timestamp")),
        f"{root}/in",
        compression="gzip",
    )
    sync.start_snapshot_sync(
        stream_snapshots(spark, f"{root}/in"),
        f"{root}/readings",
        f"{root}/checkpoint",
    ).awaitTermination()
    synced = sync.synced_readings(spark, f"{root}/readings")
    return synced.groupBy("site_id", "metric_name").agg(
        F.count(F.lit(1)).alias("readings"),
        F.round(F.avg("metric_value"), 1).alias("mean_value"),
    )


@query
def quarantine(spark, sf_dir):
    """A stream of snapshots of which every fifth line is broken or has a word for a number."""
    root = new_path(spark, "quarantine")
    snapshots = reshape.with_net_grid_flow(inputs.snapshots(spark, sf_dir)).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")
    )
    numbered = snapshots.withColumn("device_id", F.concat_ws("/", "device_id", "event_id"))
    lines = snapshot_json(numbered)
    number = F.regexp_extract("value", '"device_id":"[^"/]*/([0-9]+)"', 1).cast("long")
    broken = F.when(number % 10 == 0, F.expr("substring(value, 1, length(value) - 9)")).when(
        number % 10 == 5, F.regexp_replace("value", '"cycles":[0-9]+', '"cycles":"many"')
    )
    lines.select(F.coalesce(broken, F.col("value")).alias("value")).write.text(f"{root}/in", compression="gzip")
    sync.start_snapshot_sync(
        stream_snapshots(spark, f"{root}/in", 3, keep_malformed=True),
        f"{root}/readings", f"{root}/checkpoint",
        status_path=f"{root}/status", quarantine_path=f"{root}/quarantine",
    ).awaitTermination()
    status = sync.sync_status(spark, f"{root}/status").select("total_synced", "failed", "pending")
    kept = spark.read.parquet(f"{root}/quarantine").agg(
        F.count(F.lit(1)).alias("quarantined"),
        F.count_if(F.col("line").contains("many")).alias("words"),
    )
    synced = sync.synced_readings(spark, f"{root}/readings").agg(
        F.count(F.lit(1)).alias("readings")
    )
    # three tables of one row
    return status.join(F.broadcast(kept)).join(F.broadcast(synced))


# Small trees: the measurements of the test tables are noise.
FORECAST = dict(n_estimators=10, max_depth=4, test_size=0.2)


def _feature_frame(spark, sf_dir) -> DataFrame:
    rows = windows.rolling_mean_std(
        _run_input(spark, sf_dir), WINDOW, 6, SERIES, SERIES_ORDER
    )
    lagged = windows.lag_columns(
        rows, {"lag_1": ("metric_value", 1)}, SERIES, SERIES_ORDER
    )
    return stage(lagged, "frame")


FEATURES = ["metric_value", "hour", "rolling_avg", "rolling_std", "lag_1"]


def _trained(frame: DataFrame) -> forecast.Forecast:
    return forecast.train_forecast(
        frame,
        "metric_value",
        ForecastOptions(**FORECAST),
        rows_ahead=1,
        features=FEATURES,
        order=SERIES_ORDER,
    )


@query
def gbt_forecast(spark, sf_dir):
    """Train on the early part of every series, predict the whole frame.

    Rows of each kind: samples by split, labelled rows left out for lack of a feature,
    and for each device its rows with and without prediction.
    """
    frame = _feature_frame(spark, sf_dir)
    trained = _trained(frame)
    rows = trained.predict(frame).groupBy("device_id").agg(
        F.count("prediction").alias("predicted"), F.count(F.lit(1)).alias("rows")
    )
    return rows.select(
        "device_id",
        "predicted",
        "rows",
        F.lit(trained.samples["train"]).alias("train"),
        F.lit(trained.samples["test"]).alias("test"),
        F.lit(trained.left_out).cast("long").alias("left_out"),
    )


@query
def stored_model_metrics(spark, sf_dir):
    """A saved and loaded model predicts as the fresh one, and its stored metrics are
    those that its predictions have."""
    path = new_path(spark, "model")
    frame = _feature_frame(spark, sf_dir)
    fresh = _trained(frame)
    fresh.save(path)
    stored = forecast.stored_metrics(spark, {"load": path}).first()
    labelled = dataset.lead_target(frame, "metric_value", 1, FEATURES, SERIES, SERIES_ORDER)
    test = dataset.chrono_split(labelled, 0.2, None, SERIES, SERIES_ORDER).where(
        "split = 'test'"
    )
    loaded = forecast.Forecast.load(spark, path).predict(test)
    again = metrics.forecast_metrics(loaded, "label", "prediction", 10.0).first()
    both = loaded.select("event_id", F.col("prediction").alias("a")).join(
        fresh.predict(test).select("event_id", F.col("prediction").alias("b")), "event_id"
    )
    near = [
        (abs(stored[m] - again[m]) <= 1e-9 * max(1.0, abs(again[m]))) for m in ("mae", "rmse", "r2", "mape")
    ]
    return both.agg(
        F.lit("load").alias("target"),
        F.lit(all(near)).alias("metrics_agree"),
        F.count_if(F.col("a") == F.col("b")).alias("equal_predictions"),
    )


@query
def feature_importance(spark, sf_dir):
    """Importances are shares of one, largest first."""
    table = forecast.importance_frame(spark, _trained(_feature_frame(spark, sf_dir)))
    ranked = table.select("importance").collect()
    falling = all(a[0] >= b[0] for a, b in zip(ranked, ranked[1:]))
    return table.agg(
        F.count(F.lit(1)).alias("features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.lit(falling).alias("falling"),
    )


@query
def sequence_forecast(spark, sf_dir):
    """A linear forecast from runs of one row, which has a closed form."""
    options = SequenceOptions(
        sequence_length=1, regressor="linear", reg_param=0.0, scale_features=False, **FORECAST
    )
    trained = forecast.train_sequence_forecast(
        _run_input(spark, sf_dir),
        "metric_value",
        options,
        rows_ahead=1,
        features=["metric_value"],
        order=SERIES_ORDER,
    )
    line = trained.model.stages[0]
    facts = (
        trained.samples["train"],
        trained.samples["validation"],
        trained.samples["test"],
        float(line.coefficients[0]),
        float(line.intercept),
        trained.metrics["mae"],
    )
    found = spark.createDataFrame(
        [facts], "train long, validation long, test long, slope double, intercept double, mae double"
    )
    return _rounded(found)


@query
def sequence_forecast_long(spark, sf_dir):
    """A linear forecast from runs of 288 rows, the default, of every site's readings.

    The residuals of the training runs add up to nothing, alone and times the prediction, as those of a
    least-squares fit do; the blocks hold each row about twice.
    """
    options = SequenceOptions(
        regressor="linear", reg_param=0.0, test_size=0.2, min_rows=10, partition_cols=["site_id"]
    )
    rows = _run_input(spark, sf_dir)
    trained = forecast.train_sequence_forecast(
        rows, "metric_value", options, rows_ahead=1, features=["metric_value"], order=SERIES_ORDER
    )
    shape = runs.Shape(options.sequence_length, 1, 1)
    scaled = trained.scaler.transform(rows.withColumn("y", F.col("metric_value")))
    linear = runs.LinearRuns.of(
        scaled, ["metric_value"], "y", shape, ["site_id"], SERIES_ORDER, 0.2, options.validation_split
    )
    fit = linear.scored(trained.model.stages[0], part=0).withColumn("e", F.col("label") - F.col("prediction"))
    size = F.sum(F.abs("label"))
    close = fit.agg(
        (F.abs(F.sum("e")) < 1e-6 * size).alias("residuals_cancel"),
        (F.abs(F.sum(F.col("e") * F.col("prediction"))) < 1e-6 * F.sum(F.col("label") ** 2)).alias(
            "residuals_stand_apart"
        ),
    )
    stored = linear.blocks.agg((F.sum(F.size("y")) <= 3 * rows.count()).alias("rows_stored_little"))
    counts = trained.samples
    # two tables of one row
    return close.join(F.broadcast(stored)).select(
        F.lit(counts.get("train", 0)).cast("long").alias("train"),
        F.lit(counts.get("validation", 0)).cast("long").alias("validation"),
        F.lit(counts.get("test", 0)).cast("long").alias("test"), "*",
    )


@query
def early_stopping(spark, sf_dir):
    """Boosted runs of scaled rows that stop after two rounds without gain and go back to the best one."""
    options = SequenceOptions(
        sequence_length=6, n_estimators=12, max_depth=3, patience=2, test_size=0.2
    )
    trained = forecast.train_sequence_forecast(
        _run_input(spark, sf_dir), "metric_value", options, rows_ahead=3,
        features=["metric_value", "hour"], order=SERIES_ORDER,
    )
    losses = [h["validation_loss"] for h in trained.history]
    best = losses.index(min(losses)) + 1
    trees = trained.model.stages[0].getNumTrees
    facts = (
        trained.samples["train"], trained.samples["validation"], trained.samples["test"],
        trained.best_epoch == best,
        len(losses) == 12 or len(losses) - best == 2,
        trees == best,
        len(trained.scaler.mean),
    )
    return spark.createDataFrame(
        [facts],
        "train long, validation long, test long, best_is_least boolean, stopped_in_time boolean, "
        "best_is_kept boolean, scaled int",
    )


@query
def training_job(spark, sf_dir):
    """Both targets of one site trained from the stored table, and stored."""
    root = new_path(spark, "training")
    rows = inputs.clocked(spark, sf_dir).select(
        F.col("time").cast("timestamp").alias("time"),
        "site_id",
        "device_id",
        F.hour("time").alias("hour_of_day"),
        F.col("metric_value").alias("home_load.total_load_kw"),
        F.when(F.col("event_id") % 10 != 0, F.col("metric_value")).alias(
            "solar.generation_kw"
        ),
    )
    tables.append(rows, f"{root}/table")
    options = ForecastOptions(
        site_id="site-1", horizon_hours=2, min_rows=10, n_estimators=2, max_depth=2
    )
    done = forecast.run(spark, f"{root}/table", f"{root}/models", options)
    found = [
        (
            name,
            done["status"],
            done["features_used"],
            forecast.Forecast.load(spark, f"{root}/models/{name}").samples["train"],
            done[name].samples["test"],
        )
        for name in ("load", "solar")
    ]
    return spark.createDataFrame(
        found, "target string, status string, features int, train long, test long"
    )
