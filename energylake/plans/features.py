"""The feature job: long readings to the wide training table."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.cleaning import nan_to_null
from ..functions.temporal import with_temporal_features, with_tou_features
from ..operators.reshape import pivot_wide, project_declared
from ..operators import intervals
from ..operators.series import match_keys
from ..operators.windows import (
    by_interval_class,
    lag_columns,
    median_interval_minutes,
    rolling_mean_std,
    rolling_rows,
    samples_per_hour,
    series_facts,
)
from ..options import FeatureOptions
from ..schemas import flat
from ..session import discard, new_path, stage
from ..sources import generations, tables


def _order(options: FeatureOptions) -> list[str]:
    """Time first; where devices are mixed their names break ties."""
    return ["time"] + [c for c in schemas.SERIES if c not in options.partition_cols]


def _rolling_names(wide: DataFrame, options: FeatureOptions) -> dict[str, tuple[str, str]]:
    days = options.rolling_window_days
    return {
        flat(m): tuple(f"{flat(m)}_rolling_{s}_{days}d" for s in ("avg", "std"))
        for m in schemas.ROLLING_METRICS
        if flat(m) in wide.columns
    }


def with_rolling_features(
    wide: DataFrame,
    options: FeatureOptions,
    interval_minutes: float | None,
    longest: int | None = None,
) -> DataFrame:
    """Add the rolling features; rows lacking one of them are left out."""
    columns = _rolling_names(wide, options)
    rows = rolling_mean_std(
        wide,
        columns,
        rolling_rows(interval_minutes, options.rolling_window_days),
        options.partition_cols,
        _order(options),
        longest=longest,
    )
    return rows.dropna(subset=[name for pair in columns.values() for name in pair])


def with_lag_features(
    rows: DataFrame,
    options: FeatureOptions,
    interval_minutes: float | None,
    longest: int | None = None,
) -> DataFrame:
    """Add the value one row and one hour (in rows) before; null if an hour is no row."""
    hour = samples_per_hour(interval_minutes)
    lags = {
        f"{flat(m)}_{name}": (flat(m), k)
        for m in schemas.LAG_METRICS
        if flat(m) in rows.columns
        for name, k in (("lag_1", 1), ("lag_1h", hour))
    }
    return lag_columns(
        rows, lags, options.partition_cols, _order(options), longest=longest
    )


def with_own_windows(wide: DataFrame, options: FeatureOptions) -> DataFrame:
    """Rolling and lag features in rows of each series' exact interval, in one plan."""
    keys, order = options.partition_cols, _order(options)
    facts = intervals.series_intervals(wide, keys, order)
    rows, widest, longest = intervals.with_row_counts(
        wide,
        facts,
        keys,
        _window=intervals.day_rows(options.rolling_window_days),
        _hour=intervals.hour_rows(),
    )
    columns = _rolling_names(wide, options)
    rows = intervals.rolling_mean_std(
        rows, columns, "_window", widest["_window"], keys, order, longest=longest
    ).dropna(subset=[name for pair in columns.values() for name in pair])
    rows = rows.withColumn("_one", F.lit(1).cast("long"))
    lags = {
        f"{flat(m)}_{name}": (flat(m), k)
        for m in schemas.LAG_METRICS
        if flat(m) in wide.columns
        for name, k in (("lag_1", "_one"), ("lag_1h", "_hour"))
    }
    rows = intervals.lag_columns(
        rows, lags, max(1, widest["_hour"]), keys, order, longest=longest
    )
    return rows.drop("_window", "_hour", "_one")


def build_features(
    readings: DataFrame,
    options: FeatureOptions | None = None,
    staging_path: str | None = None,
) -> DataFrame:
    """Wide feature rows under column-safe names.

    The wide rows are staged; one pass over their times gives the rows and the interval
    of every series.  Windows and lags are counted in rows of the series' own interval, so
    devices of different sampling rates stand side by side.  Lags follow the
    removal of rows without full window, so their order is that of the remaining rows.
    Where all devices are one series, its interval is their common median.
    """
    options = options or FeatureOptions()
    options.validate()
    keys, order = options.partition_cols, _order(options)
    root = staging_path or new_path(readings.sparkSession, "features")
    wide = stage(
        pivot_wide(readings, order_col=options.order_col), "wide", f"{root}/wide"
    )

    def add(rows: DataFrame, minutes: float | None, longest: int | None = None) -> DataFrame:
        rows = with_rolling_features(rows, options, minutes, longest)
        return with_lag_features(rows, options, minutes, longest)

    if options.intervals == "classes":
        facts = stage(series_facts(wide, keys, order), "facts", f"{root}/facts")
        rows = by_interval_class(wide, facts, keys, add)
    elif keys:
        rows = with_own_windows(wide, options)
    else:
        rows = add(wide, median_interval_minutes(wide, keys, order))
    rows = with_temporal_features(rows)
    return with_tou_features(rows, options.tou_peak_hours, options.tou_shoulder_hours)


def training_table(features: DataFrame, options: FeatureOptions | None = None):
    """Feature rows as stored: declared columns and names, no NaN."""
    options = options or FeatureOptions()
    declared = schemas.feature_columns(options.rolling_window_days)
    return project_declared(nan_to_null(features), declared)


def run(
    spark: SparkSession,
    readings_path: str,
    training_path: str,
    options: FeatureOptions | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    only: DataFrame | None = None,
) -> dict:
    """Scan readings, build features, upsert the training table; a summary.

    `only` has the series to build, where not all are wanted.  Data and options that do not serve give a
    status; any other error is raised.
    """
    options = options or FeatureOptions()
    nothing = {"records_processed": 0, "records_stored": 0}
    if not options.enabled:
        return {"status": "disabled", **nothing}
    started = time.monotonic()
    staged = new_path(spark, "features")
    try:
        options.validate()
        readings = tables.scan_readings(
            spark, readings_path, start, end, options.site_id, options.lookback_days, fold=False
        )
        if only is not None:
            readings = match_keys(readings, only, options.partition_cols, "left_semi")
        if readings.isEmpty():
            return {"status": "no_data", **nothing}
        readings = tables.folded(readings)
        table = training_table(build_features(readings, options, staged), options)
        if spark.read.parquet(f"{staged}/wide").isEmpty():
            return {"status": "pivot_failed", **nothing}
        seen = Observation()
        rows = table.observe(seen, F.count(F.lit(1)).alias("n"))
        # works the rows out once, as it writes them to a place of its own first
        tables.upsert(rows, training_path, schemas.KEY)
        return {
            "status": "success",
            "records_processed": seen.get["n"],
            "records_stored": seen.get["n"],
            "features_count": len(table.columns),
            "elapsed_seconds": time.monotonic() - started,
        }
    except (ValueError, OSError, PySparkException) as error:
        return {"status": "error", "error": str(error), **nothing}
    finally:
        discard(spark, staged)


def _after(seen: dict[int, int]) -> Column:
    """Whether a row has come in since the newest versions `seen`, by epoch."""
    version, batches = F.col(tables.VERSION), tables.BATCHES
    new = version >= (max(seen) + 1) * batches if seen else F.lit(True)
    for epoch in range(max(seen, default=-1) + 1):
        newest = seen.get(epoch, epoch * batches - 1)
        new |= (version > newest) & (version < (epoch + 1) * batches)
    return new


def run_changed(
    spark: SparkSession,
    readings_path: str,
    training_path: str,
    state_path: str,
    options: FeatureOptions | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> dict:
    """The feature job for the series that have new, late or changed readings since its last run.

    Readings must be versioned, as the sync stores them.  The newest version of each epoch that a run has seen is
    kept at `state_path`; files with older versions only are skipped by their statistics.  A series is built from
    all its readings of the range, as windows count rows and a late one moves all after it, so the training
    table is that of `run`.  The summary adds the number of series that were built.
    """
    options = options or FeatureOptions()
    if not options.partition_cols:
        raise ValueError("all devices are one series: any change concerns all rows")
    readings = tables.table(spark, readings_path)
    epoch = F.floor(F.col(tables.VERSION) / tables.BATCHES).cast("long")
    lines = generations.read_lines(spark, state_path) or []
    seen = {int(e): int(v) for e, v in (line.split("\t") for line in lines)}
    fresh = readings.where(_after(seen)).select(*options.partition_cols, tables.VERSION)
    place = new_path(spark, "changed")
    try:
        changed = stage(
            fresh.groupBy(*options.partition_cols, epoch.alias("epoch")).agg(F.max(tables.VERSION).alias("newest")),
            "changed",
            place,
        )
        # one row per checkpoint that has written
        newest = changed.groupBy("epoch").agg(F.max("newest").alias("newest")).collect()
        series = changed.select(*options.partition_cols).distinct()
        built = series.count()
        if not built:
            return {"status": "unchanged", "series_built": 0, "records_processed": 0, "records_stored": 0}
        done = run(spark, readings_path, training_path, options, start, end, series)
        if done["status"] in ("success", "no_data"):
            seen |= {r["epoch"]: r["newest"] for r in newest}
            generations.write_lines(spark, state_path, [f"{e}\t{v}" for e, v in sorted(seen.items())])
        return done | {"series_built": built}
    finally:
        discard(spark, place)
