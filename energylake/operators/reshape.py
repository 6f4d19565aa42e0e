"""Snapshots to points, points to readings, readings to wide rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.cleaning import finite, round_half_even, to_number
from ..schemas import flat


# --- snapshots -------------------------------------------------------------


def net_grid_flow(
    load_kw: Column | str, solar_kw: Column | str, battery_kw: Column | str
) -> Column:
    """Power drawn from the grid; a charging battery consumes."""
    load_kw, solar_kw, battery_kw = (
        F.col(c) if isinstance(c, str) else c for c in (load_kw, solar_kw, battery_kw)
    )
    return load_kw - solar_kw + battery_kw


def with_net_grid_flow(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn(
        "net_grid_flow_kw",
        net_grid_flow(
            "home_load.total_load_kw", "solar.generation_kw", "battery.power_kw"
        ),
    )


def rounded_snapshot(snapshots: DataFrame) -> DataFrame:
    """Round each field to the decimals of its JSON form, halves to even."""
    columns = {
        "net_grid_flow_kw": round_half_even(
            F.col("net_grid_flow_kw"), schemas.NET_FLOW_DECIMALS
        )
    }
    for record, decimals in schemas.SNAPSHOT_DECIMALS.items():
        columns[record] = F.col(record)
        for field, places in decimals.items():
            columns[record] = columns[record].withField(
                field, round_half_even(F.col(f"{record}.{field}"), places)
            )
    return snapshots.withColumns(columns)


def snapshot_points(snapshots: DataFrame) -> DataFrame:
    """One row per measurement and field; `system` repeats four other fields."""
    entries = []
    for measurement, fields in schemas.MEASUREMENT_FIELDS.items():
        for field in fields:
            source = (
                schemas.SYSTEM_FIELD_SOURCES[field]
                if measurement == "system"
                else f"{measurement}.{field}"
            )
            tag = (
                F.col("grid_price.time_of_use_period")
                if measurement == "grid_price"
                else F.lit(None).cast("string")
            )
            entries.append(
                F.struct(
                    F.lit(measurement).alias("measurement"),
                    tag.alias("time_of_use_period"),
                    F.lit(field).alias("field"),
                    F.col(source).cast("double").alias("value"),
                )
            )
    others = [
        c
        for c in snapshots.columns
        if c not in {f.name for f in schemas.SNAPSHOT.fields}
    ]
    return snapshots.select(
        F.col("timestamp").alias("time"),
        "device_id",
        *others,
        F.inline(F.array(*entries)),
    )


# --- readings --------------------------------------------------------------


def known_fields(measurement: str = "measurement", field: str = "field") -> Column:
    """Whether a point is in the catalogue of synced measurements and fields."""
    known = F.lit(False)
    for name, fields in schemas.MEASUREMENT_FIELDS.items():
        known = known | ((F.col(measurement) == name) & F.col(field).isin(fields))
    return known


def points_to_readings(points: DataFrame, site_id: Column | str, *kept: str) -> DataFrame:
    """Long readings; points without time or numeric value are left out.  The columns `kept` stay."""
    site = F.lit(site_id) if isinstance(site_id, str) else site_id
    return points.select(
        "time",
        site.alias("site_id"),
        F.coalesce("device_id", F.lit(schemas.UNKNOWN_DEVICE)).alias("device_id"),
        F.concat_ws(".", "measurement", "field").alias("metric_name"),
        to_number(F.col("value")).alias("metric_value"),
        *kept,
    ).dropna(subset=["time", "metric_value"])


def union_measurements(points: DataFrame, measurements: Sequence[str]) -> DataFrame:
    """Points of several measurements; unknown names are skipped.

    One scan with a filter takes the place of a union of scans.
    """
    wanted = [m for m in measurements if m in schemas.MEASUREMENT_FIELDS]
    return points.where(F.col("measurement").isin(wanted) & known_fields())


def duplicate_groups(
    readings: DataFrame, key: Sequence[str] = tuple(schemas.READING_KEY)
) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (
        readings.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def latest_per_key(
    df: DataFrame, key: Sequence[str], version: str | Column, near: Sequence[str] = ()
) -> DataFrame:
    """One row per key, the one of the highest version; null is the lowest.

    An aggregate and not a ranking window: copies of a key are merged in the
    map tasks, so a key with very many copies does not meet in one task.  Where keys have few
    copies, `near` names columns of the key by which rows are brought together first: they move as
    they are then, without a sort before, and beside the rows that they compress well with.
    """
    if near:
        df = df.repartition(*[F.col(f"`{c}`") for c in near])
    version = F.col(version) if isinstance(version, str) else version
    payload = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(f"`{c}`") for c in payload])
    # max_by ignores rows whose order is null; a struct never is
    rank = F.struct(version.isNotNull().alias("known"), version.alias("version"))
    return (
        df.groupBy(*key)
        .agg(F.max_by(row, rank).alias("_row"))
        .select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in payload])
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def pivot_wide(
    readings: DataFrame,
    metrics: Sequence[str] = tuple(schemas.METRICS),
    order_col: str | None = None,
    keys: Sequence[str] = tuple(schemas.KEY),
) -> DataFrame:
    """Wide rows, one column per metric; of duplicates the first by `order_col`.

    Written as one conditional aggregate per metric: unlike a two-step pivot it
    needs a single shuffle, and copies are merged before it.  Without
    `order_col` the smallest value stands for its duplicates.  Rows without any
    finite value are left out.
    """
    value = F.col("metric_value")
    names = F.array(*[F.lit(m) for m in metrics])

    def cell(number: int) -> Column:
        mine = F.col("_metric") == number
        if order_col is None:
            return F.min(F.when(mine, value))
        return F.min_by(F.when(mine, value), F.when(mine, F.col(order_col)))

    return (
        readings.where(
            F.col("metric_name").isin(list(metrics)) & finite(value).isNotNull()
        )
        # compared as a number from here on, once per metric
        .withColumn("_metric", F.array_position(names, F.col("metric_name")))
        .groupBy(*keys)
        .agg(*[cell(i).alias(flat(m)) for i, m in enumerate(metrics, 1)])
    )


# --- projections -----------------------------------------------------------


def normalise_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.toDF(*[flat(c) for c in df.columns])


def training_features(training_data: DataFrame) -> DataFrame:
    """The training table under column-safe names, in declared order."""
    return training_data.select(
        *[F.col(f"`{c}`").alias(flat(c)) for c in training_data.columns]
    )


def project_declared(df: DataFrame, declared: Sequence[str]) -> DataFrame:
    """Declared columns that `df` has, under their declared (dotted) names."""
    here = set(df.columns)
    return df.select(
        *[
            F.col(f"`{c if c in here else flat(c)}`").alias(c)
            for c in declared
            if c in here or flat(c) in here
        ]
    )


def select_features(
    df: DataFrame, declared: Sequence[str]
) -> tuple[list[str], list[str]]:
    """Declared features that `df` has, and the sorted names of those missing."""
    here = set(df.columns)
    available = [c for c in declared if c in here]
    return available, sorted(set(declared) - here)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
