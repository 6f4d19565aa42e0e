"""The given tables in the shape of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.reshape import pivot_wide
from ..operators.series import with_positions
from ..operators.windows import lag_columns

METRIC_OF_EVENT = {
    "click": "solar.generation_kw",
    "view": "home_load.total_load_kw",
    "purchase": "battery.power_kw",
    "signup": "battery.soc_percent",
    "error": "grid_price.price_per_kwh",
}
PERIOD_OF_EVENT = {"click": "peak", "error": "peak", "purchase": "shoulder"}


#: events that one task turns into snapshots; each of them becomes many points
TASK_EVENTS = 200_000
#: rows of a device that are numbered in one task
NUMBERED_ROWS = 500_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(events: DataFrame, most: int = TASK_EVENTS) -> DataFrame:
    """Events dealt by time to tasks of about `most` rows, as a file of narrow rows holds millions of them."""
    tasks = -(-events.count() // most)
    return events.repartitionByRange(tasks, "ts", "event_id") if tasks > 1 else events


def ntz(time: Column) -> Column:
    return time.cast("timestamp_ntz")


def _mapped(col: Column, mapping: dict[str, str], otherwise: Column) -> Column:
    value = otherwise
    for key, result in mapping.items():
        value = F.when(col == key, result).otherwise(value)
    return value


def _site() -> Column:
    return F.concat(F.lit("site-"), (F.col("user_id") % 3).cast("string"))


def _k() -> Column:
    return F.get_json_object("props", "$.k")


def readings(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One reading per event; the event type tells the metric."""
    return load(spark, sf_dir, "events").select(
        F.col("ts").alias("time"),
        _site().alias("site_id"),
        F.col("user_id").cast("string").alias("device_id"),
        _mapped(
            F.col("event_type"), METRIC_OF_EVENT, F.lit(None).cast("string")
        ).alias("metric_name"),
        F.col("value").alias("metric_value"),
        "event_id",
        *extra,
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings, and a newer copy of every tenth with its value raised by 1."""
    first = readings(spark, sf_dir)
    return first.withColumn("version", F.lit(1)).unionByName(newer(first))


def newer(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("event_id") % 10 == 0)
        .withColumn("metric_value", F.col("metric_value") + 1)
        .withColumn("version", F.lit(2))
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry points with text values, some of them no numbers.

    Every 10th point lacks its device, every 7th carries JSON as value, every
    13th has no value.
    """
    metric = F.split("metric_name", r"\.")
    value = F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(_k())
    return readings(spark, sf_dir, "props").select(
        "time",
        "site_id",
        metric[0].alias("measurement"),
        metric[1].alias("field"),
        F.when(F.col("event_id") % 10 != 0, F.col("device_id")).alias("device_id"),
        F.when(F.col("event_id") % 13 != 0, value).alias("value"),
        "event_id",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested snapshot per event, all fields worked out from `value` and `k`."""
    v, k = F.col("value"), F.col("k")

    def record(**fields: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    events = spread(load(spark, sf_dir, "events")).withColumn("k", _k().cast("double"))
    return events.select(
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("device_id"),
        record(
            generation_kw=v / 10,
            irradiance_w_m2=v * 4,
            panel_temp_celsius=20 + k / 4,
            efficiency_percent=15 + k / 20,
        ).alias("solar"),
        record(
            soc_percent=10 + k * 0.8,
            capacity_kwh=F.lit(13.5),
            power_kw=(k - 50) / 10,
            voltage_v=48 + k / 50,
            temperature_celsius=25 + k / 10,
            cycles=(F.col("event_id") % 3000).cast("int"),
            health_percent=100 - k / 10,
        ).alias("battery"),
        record(
            total_load_kw=v / 20 + v / 50 + v / 100 + (k % 7) / 2 + 0.5,
            hvac_kw=v / 20,
            appliances_kw=v / 50,
            lighting_kw=v / 100,
            ev_charging_kw=(k % 7) / 2,
            other_kw=F.lit(0.5),
        ).alias("home_load"),
        record(
            price_per_kwh=0.05 + k / 400,
            feed_in_tariff=F.lit(0.04),
            demand_charge=F.lit(10.0),
            time_of_use_period=_mapped(
                F.col("event_type"), PERIOD_OF_EVENT, F.lit("off_peak")
            ),
            carbon_intensity_g_kwh=300 + k * 2,
        ).alias("grid_price"),
        _site().alias("site_id"),
        "event_id",
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a forecast: the price, and the customer's price before it."""
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderdate",
        "o_orderkey",
        "o_orderpriority",
        F.col("o_totalprice").alias("actual"),
    )
    return lag_columns(
        orders,
        {"predicted": ("actual", 1)},
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
    ).dropna(subset=["predicted"])


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as readings of one metric over many months."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("time"),
        F.concat(F.lit("site-"), (F.col("o_custkey") % 3).cast("string")).alias(
            "site_id"
        ),
        F.col("o_custkey").cast("string").alias("device_id"),
        F.col("o_orderkey").cast("string").alias("metric_name"),
        F.col("o_totalprice").alias("metric_value"),
    )


def _numbered(events: DataFrame, devices: int, most: int = NUMBERED_ROWS) -> DataFrame:
    """Events of so many devices with their place in their device's time order, from 0."""
    rows = events.select(
        "event_id", "ts", "value", (F.col("user_id") % devices).alias("device")
    )
    return with_positions(
        rows, ["device"], ["ts", "event_id"], "place", "device_rows", max_rows=most
    ).drop("device_rows")


def clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as devices that sample every 5, 15 or 120 minutes."""
    device = F.col("device")
    rows = _numbered(load(spark, sf_dir, "events"), 3).select(
        "event_id",
        F.concat(F.lit("device-"), device.cast("string")).alias("device_id"),
        F.when(device == 0, 5).when(device == 1, 15).otherwise(120).alias("step"),
        F.col("place").cast("int").alias("place"),
        F.col("value").alias("metric_value"),
    )
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return rows.select(
        (start + F.make_dt_interval(mins=F.col("step") * F.col("place"))).alias("time"),
        F.when(F.col("step") == 5, "site-0").otherwise("site-1").alias("site_id"),
        "device_id",
        "metric_value",
        "event_id",
    )


def unusual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as devices that sample every 0.5 or 10 seconds, 7 or 45 minutes, and miss every eleventh sample."""
    device = F.col("device")
    step = F.when(device == 0, 500_000).when(device == 1, 10_000_000)
    step = step.when(device == 2, 420_000_000).otherwise(2_700_000_000)
    rows = _numbered(load(spark, sf_dir, "events"), 4).select(
        "event_id", F.col("value").alias("metric_value"),
        F.concat(F.lit("device-"), device.cast("string")).alias("device_id"),
        step.cast("long").alias("step"), "place",
    )
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    micros = start + (F.col("place") + F.floor(F.col("place") / 10)) * F.col("step")
    return rows.select(
        F.timestamp_micros(micros).alias("time"), "device_id", "metric_value", "event_id"
    )


def wide_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as wide rows, one column per metric, most of them null."""
    return pivot_wide(
        readings(spark, sf_dir), list(METRIC_OF_EVENT.values()), "event_id"
    )


SERIES_ORDER = ["time", "event_id"]
SERIES = list(schemas.SERIES)
