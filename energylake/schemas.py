"""Table schemas and metric catalogues."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Measurement, field and feature names of the telemetry model.
# ---------------------------------------------------------------------------
MEASUREMENT_FIELDS: dict[str, list[str]] = {
    "solar": [
        "generation_kw",
        "irradiance_w_m2",
        "panel_temp_celsius",
        "efficiency_percent",
    ],
    "battery": [
        "soc_percent",
        "capacity_kwh",
        "power_kw",
        "voltage_v",
        "temperature_celsius",
        "cycles",
        "health_percent",
    ],
    "home_load": [
        "total_load_kw",
        "hvac_kw",
        "appliances_kw",
        "lighting_kw",
        "ev_charging_kw",
        "other_kw",
    ],
    "grid_price": [
        "price_per_kwh",
        "feed_in_tariff",
        "demand_charge",
        "carbon_intensity_g_kwh",
    ],
    "system": [
        "net_grid_flow_kw",
        "solar_generation_kw",
        "battery_soc_percent",
        "total_load_kw",
        "price_per_kwh",
    ],
}

# Where each field of the `system` measurement is taken from in a snapshot.
SYSTEM_FIELD_SOURCES: dict[str, str] = {
    "net_grid_flow_kw": "net_grid_flow_kw",
    "solar_generation_kw": "solar.generation_kw",
    "battery_soc_percent": "battery.soc_percent",
    "total_load_kw": "home_load.total_load_kw",
    "price_per_kwh": "grid_price.price_per_kwh",
}

# Decimal places of each snapshot field in its JSON form.
SNAPSHOT_DECIMALS: dict[str, dict[str, int]] = {
    "solar": {
        "generation_kw": 3,
        "irradiance_w_m2": 2,
        "panel_temp_celsius": 1,
        "efficiency_percent": 2,
    },
    "battery": {
        "soc_percent": 2,
        "capacity_kwh": 2,
        "power_kw": 3,
        "voltage_v": 1,
        "temperature_celsius": 1,
        "health_percent": 2,
    },
    "home_load": {
        "total_load_kw": 3,
        "hvac_kw": 3,
        "appliances_kw": 3,
        "lighting_kw": 3,
        "ev_charging_kw": 3,
        "other_kw": 3,
    },
    "grid_price": {
        "price_per_kwh": 4,
        "feed_in_tariff": 4,
        "demand_charge": 4,
        "carbon_intensity_g_kwh": 2,
    },
}
NET_FLOW_DECIMALS = 3

# Metrics kept as columns of the wide table.
METRICS: list[str] = [
    "solar.generation_kw",
    "solar.irradiance_w_m2",
    "solar.panel_temp_celsius",
    "solar.efficiency_percent",
    "battery.soc_percent",
    "battery.power_kw",
    "battery.temperature_celsius",
    "battery.health_percent",
    "home_load.total_load_kw",
    "home_load.hvac_kw",
    "home_load.appliances_kw",
    "home_load.lighting_kw",
    "home_load.ev_charging_kw",
    "grid_price.price_per_kwh",
    "grid_price.feed_in_tariff",
    "grid_price.demand_charge",
    "grid_price.carbon_intensity_g_kwh",
    "system.net_grid_flow_kw",
]

ROLLING_METRICS: list[str] = [
    "solar.generation_kw",
    "home_load.total_load_kw",
    "battery.soc_percent",
    "grid_price.price_per_kwh",
    "system.net_grid_flow_kw",
]

LAG_METRICS: list[str] = [
    "solar.generation_kw",
    "home_load.total_load_kw",
    "grid_price.price_per_kwh",
]

TEMPORAL_FEATURES: list[str] = [
    "hour_of_day",
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "hour_sin",
    "hour_cos",
    "day_sin",
    "day_cos",
]

TOU_FEATURES: list[str] = ["tou_peak", "tou_off_peak", "tou_shoulder"]

# Raw metrics that forecasts use directly.
FORECAST_METRICS: list[str] = [
    "solar.irradiance_w_m2",
    "solar.panel_temp_celsius",
    "battery.soc_percent",
    "grid_price.price_per_kwh",
]

TARGETS: dict[str, str] = {
    "load": "home_load.total_load_kw",
    "solar": "solar.generation_kw",
}
# ---------------------------------------------------------------------------

KEY = ["time", "site_id", "device_id"]
SERIES = ["site_id", "device_id"]
READING_KEY = ["time", "site_id", "device_id", "metric_name"]
UNKNOWN_DEVICE = "unknown"


def flat(name: str) -> str:
    """Column-safe form of a dotted metric name."""
    return name.replace(".", "_")


def rolling_columns(days: int) -> list[str]:
    return [
        f"{flat(m)}_rolling_{stat}_{days}d"
        for m in ROLLING_METRICS
        for stat in ("avg", "std")
    ]


def lag_columns() -> list[str]:
    return [f"{flat(m)}_{lag}" for m in LAG_METRICS for lag in ("lag_1", "lag_1h")]


def feature_columns(days: int = 7) -> list[str]:
    """All columns of `training_data`, dotted metric names included."""
    return (
        KEY
        + METRICS
        + TEMPORAL_FEATURES
        + rolling_columns(days)
        + TOU_FEATURES
        + lag_columns()
    )


def forecast_features(days: int = 7) -> list[str]:
    """Declared inputs of the forecasts, in column-safe form."""
    return (
        TEMPORAL_FEATURES
        + TOU_FEATURES
        + rolling_columns(days)
        + lag_columns()
        + [flat(m) for m in FORECAST_METRICS]
    )


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _record(measurement: str) -> T.StructType:
    return T.StructType(_doubles(MEASUREMENT_FIELDS[measurement]))


BATTERY = T.StructType(
    [
        T.StructField(n, T.IntegerType() if n == "cycles" else T.DoubleType())
        for n in MEASUREMENT_FIELDS["battery"]
    ]
)

GRID_PRICE = T.StructType(
    _doubles(["price_per_kwh", "feed_in_tariff", "demand_charge"])
    + [
        T.StructField("time_of_use_period", T.StringType()),
        T.StructField("carbon_intensity_g_kwh", T.DoubleType()),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("solar", _record("solar")),
        T.StructField("battery", BATTERY),
        T.StructField("home_load", _record("home_load")),
        T.StructField("grid_price", GRID_PRICE),
        T.StructField("net_grid_flow_kw", T.DoubleType()),
    ]
)

POINT = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("measurement", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("time_of_use_period", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

READING = T.StructType(
    [
        T.StructField("time", T.TimestampType(), False),
        T.StructField("site_id", T.StringType(), False),
        T.StructField("device_id", T.StringType(), False),
        T.StructField("metric_name", T.StringType(), False),
        T.StructField("metric_value", T.DoubleType(), False),
    ]
)

_INT_FEATURES = {
    "hour_of_day",
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    *TOU_FEATURES,
}


def training_data_schema(days: int = 7) -> T.StructType:
    def kind(name: str) -> T.DataType:
        if name == "time":
            return T.TimestampType()
        if name in ("site_id", "device_id"):
            return T.StringType()
        return T.IntegerType() if name in _INT_FEATURES else T.DoubleType()

    return T.StructType(
        [T.StructField(n, kind(n), n not in KEY) for n in feature_columns(days)]
    )
