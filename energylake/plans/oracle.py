"""The registered queries in SQL, written apart from the library."""

from __future__ import annotations

READINGS = """
readings AS (
  SELECT ts AS time, 'site-' || CAST(user_id % 3 AS VARCHAR) AS site_id,
         CAST(user_id AS VARCHAR) AS device_id,
         CASE event_type WHEN 'click' THEN 'solar.generation_kw'
                         WHEN 'view' THEN 'home_load.total_load_kw'
                         WHEN 'purchase' THEN 'battery.power_kw'
                         WHEN 'signup' THEN 'battery.soc_percent'
                         WHEN 'error' THEN 'grid_price.price_per_kwh' END AS metric_name,
         value AS metric_value, event_id
  FROM events)"""

VERSIONS = (
    READINGS
    + """,
versions AS (
  SELECT *, 1 AS version FROM readings
  UNION ALL
  SELECT time, site_id, device_id, metric_name, metric_value + 1, event_id, 2
  FROM readings WHERE event_id % 10 = 0)"""
)

LATEST = (
    VERSIONS
    + """,
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY time, site_id, device_id, metric_name
                                 ORDER BY version DESC) AS rn FROM versions)
  WHERE rn = 1)"""
)

POINTS = """
points AS (
  SELECT ts AS time, 'site-' || CAST(user_id % 3 AS VARCHAR) AS site_id,
         CASE event_type WHEN 'click' THEN 'solar' WHEN 'view' THEN 'home_load'
                         WHEN 'error' THEN 'grid_price' ELSE 'battery' END AS measurement,
         CASE event_type WHEN 'click' THEN 'generation_kw' WHEN 'view' THEN 'total_load_kw'
                         WHEN 'purchase' THEN 'power_kw' WHEN 'signup' THEN 'soc_percent'
                         ELSE 'price_per_kwh' END AS field,
         CASE WHEN event_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS device_id,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN props
              ELSE json_extract_string(props, '$.k') END AS value,
         event_id
  FROM events)"""

SNAPSHOTS = """
base AS (
  SELECT *, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events),
flatsnap AS (
  SELECT event_id, ts AS time, 'site-' || CAST(user_id % 3 AS VARCHAR) AS site_id,
         CAST(user_id AS VARCHAR) AS device_id,
         v / 10 AS solar_generation_kw, v * 4 AS solar_irradiance_w_m2,
         20 + k / 4 AS solar_panel_temp_celsius, 15 + k / 20 AS solar_efficiency_percent,
         10 + k * CAST(0.8 AS DOUBLE) AS battery_soc_percent,
         CAST(13.5 AS DOUBLE) AS battery_capacity_kwh, (k - 50) / 10 AS battery_power_kw,
         48 + k / 50 AS battery_voltage_v, 25 + k / 10 AS battery_temperature_celsius,
         CAST(event_id % 3000 AS INTEGER) AS battery_cycles,
         100 - k / 10 AS battery_health_percent,
         v / 20 + v / 50 + v / 100 + (k % 7) / 2 + CAST(0.5 AS DOUBLE)
           AS home_load_total_load_kw,
         v / 20 AS home_load_hvac_kw, v / 50 AS home_load_appliances_kw,
         v / 100 AS home_load_lighting_kw, (k % 7) / 2 AS home_load_ev_charging_kw,
         CAST(0.5 AS DOUBLE) AS home_load_other_kw,
         CAST(0.05 AS DOUBLE) + k / 400 AS grid_price_price_per_kwh,
         CAST(0.04 AS DOUBLE) AS grid_price_feed_in_tariff,
         CAST(10 AS DOUBLE) AS grid_price_demand_charge,
         300 + k * 2 AS grid_price_carbon_intensity_g_kwh,
         CASE event_type WHEN 'click' THEN 'peak' WHEN 'error' THEN 'peak'
                         WHEN 'purchase' THEN 'shoulder' ELSE 'off_peak' END AS period
  FROM base),
snap AS (
  SELECT *, home_load_total_load_kw - solar_generation_kw + battery_power_kw
            AS system_net_grid_flow_kw
  FROM flatsnap)"""

FIELDS = [
    ("solar", "generation_kw", "solar_generation_kw"),
    ("solar", "irradiance_w_m2", "solar_irradiance_w_m2"),
    ("solar", "panel_temp_celsius", "solar_panel_temp_celsius"),
    ("solar", "efficiency_percent", "solar_efficiency_percent"),
    ("battery", "soc_percent", "battery_soc_percent"),
    ("battery", "capacity_kwh", "battery_capacity_kwh"),
    ("battery", "power_kw", "battery_power_kw"),
    ("battery", "voltage_v", "battery_voltage_v"),
    ("battery", "temperature_celsius", "battery_temperature_celsius"),
    ("battery", "cycles", "CAST(battery_cycles AS DOUBLE)"),
    ("battery", "health_percent", "battery_health_percent"),
    ("home_load", "total_load_kw", "home_load_total_load_kw"),
    ("home_load", "hvac_kw", "home_load_hvac_kw"),
    ("home_load", "appliances_kw", "home_load_appliances_kw"),
    ("home_load", "lighting_kw", "home_load_lighting_kw"),
    ("home_load", "ev_charging_kw", "home_load_ev_charging_kw"),
    ("home_load", "other_kw", "home_load_other_kw"),
    ("grid_price", "price_per_kwh", "grid_price_price_per_kwh"),
    ("grid_price", "feed_in_tariff", "grid_price_feed_in_tariff"),
    ("grid_price", "demand_charge", "grid_price_demand_charge"),
    ("grid_price", "carbon_intensity_g_kwh", "grid_price_carbon_intensity_g_kwh"),
    ("system", "net_grid_flow_kw", "system_net_grid_flow_kw"),
    ("system", "solar_generation_kw", "solar_generation_kw"),
    ("system", "battery_soc_percent", "battery_soc_percent"),
    ("system", "total_load_kw", "home_load_total_load_kw"),
    ("system", "price_per_kwh", "grid_price_price_per_kwh"),
]


def _points_union() -> str:
    return "\n  UNION ALL ".join(
        f"SELECT time, site_id, device_id, '{m}' AS measurement, "
        f"{'period' if m == 'grid_price' else 'CAST(NULL AS VARCHAR)'} "
        f"AS time_of_use_period, '{f}' AS field, {e} AS value FROM snap"
        for m, f, e in FIELDS
    )


SNAP_POINTS = SNAPSHOTS + ",\nsnap_points AS (" + _points_union() + ")"

SERIES = "PARTITION BY site_id, device_id ORDER BY time, event_id"

METRICS = [
    "solar_generation_kw",
    "solar_irradiance_w_m2",
    "solar_panel_temp_celsius",
    "solar_efficiency_percent",
    "battery_soc_percent",
    "battery_power_kw",
    "battery_temperature_celsius",
    "battery_health_percent",
    "home_load_total_load_kw",
    "home_load_hvac_kw",
    "home_load_appliances_kw",
    "home_load_lighting_kw",
    "home_load_ev_charging_kw",
    "grid_price_price_per_kwh",
    "grid_price_feed_in_tariff",
    "grid_price_demand_charge",
    "grid_price_carbon_intensity_g_kwh",
    "system_net_grid_flow_kw",
]
ROLLING = [
    "solar_generation_kw",
    "home_load_total_load_kw",
    "battery_soc_percent",
    "grid_price_price_per_kwh",
    "system_net_grid_flow_kw",
]
LAGS = ["solar_generation_kw", "home_load_total_load_kw", "grid_price_price_per_kwh"]

D = "CAST({} AS DOUBLE)".format
TWO_PI = "(2 * pi())"
DAY = "(isodow({t}) - 1)"


def _tou(hour: str) -> str:
    return f"""
      CAST({hour} >= 16 AND {hour} < 21 AS INTEGER) AS tou_peak,
      CAST({hour} < 7 OR {hour} >= 22 AS INTEGER) AS tou_off_peak,
      CAST(({hour} >= 7 AND {hour} < 16) OR {hour} = 21 AS INTEGER) AS tou_shoulder"""


def _r(expression: str) -> str:
    """Rounded, ties put on one side (see `queries._rounded`)."""
    return f"round({expression} + {D(1e-8)}, 4)"


#: sampling intervals in minutes; a median belongs to the next one by ratio
CLASSES = (1, 2, 5, 10, 15, 20, 30, 60, 120, 180, 240, 360, 720, 1440)


def _feature_build(days: int, partition: str, tie: str, exact: bool = False) -> str:
    over = f"{partition} ORDER BY time{tie}"
    stats = ",\n".join(
        f"count({m}) OVER w AS c_{m}, avg({m}) OVER w AS a_{m}, "
        f"stddev_samp({m}) OVER w AS s_{m}"
        for m in ROLLING
    )
    full = " AND ".join(f"c_{m} = n AND s_{m} IS NOT NULL" for m in ROLLING)
    rolling = ", ".join(
        f"{_r(f'a_{m}')} AS {m}_rolling_avg_{days}d, "
        f"{_r(f's_{m}')} AS {m}_rolling_std_{days}d"
        for m in ROLLING
    )
    lags = ", ".join(
        f"{_r(f'lag({m}, 1) OVER w2')} AS {m}_lag_1, "
        f"CASE WHEN kh > 0 THEN {_r(f'lag({m}, kh) OVER w2')} END AS {m}_lag_1h"
        for m in LAGS
    )
    day = DAY.format(t="time")

    key = "site_id || '/' || device_id" if partition else "''"
    bounds = list(zip(CLASSES, CLASSES[1:]))
    cases = " ".join(f"WHEN minutes < sqrt({a} * {b}) THEN {a}" for a, b in bounds)
    snapped = f"CASE WHEN minutes IS NULL OR minutes <= 0 THEN 5 {cases} ELSE {CLASSES[-1]} END"
    median, interval = "median(floor(gap / 1e6)) / 60", snapped
    if exact:
        median, interval = "median(gap) / 6e7", "CASE WHEN minutes > 0 THEN minutes ELSE 5 END"
    return f"""WITH {SNAPSHOTS},
gaps AS (
  SELECT {key} AS series, epoch_us(time) - lag(epoch_us(time)) OVER ({over}) AS gap
  FROM snap),
medians AS (
  SELECT series, {median} AS minutes FROM gaps GROUP BY series),
classes AS (
  SELECT series, {interval} AS minutes FROM medians),
sized AS (
  SELECT snap.*, greatest(1, CAST(round_even(1440 / minutes, 0) AS BIGINT) * {days}) AS n,
         CAST(round_even(60 / minutes, 0) AS BIGINT) AS kh
  FROM snap JOIN classes ON classes.series = {key}),
rolled AS (
  SELECT * FROM (
    SELECT *, {stats} FROM sized
    WINDOW w AS ({over} ROWS BETWEEN (n - 1) PRECEDING AND CURRENT ROW))
  WHERE {full})
SELECT time, site_id, device_id,
       {", ".join(f"{_r(m)} AS {m}" for m in METRICS)},
       CAST(hour(time) AS INTEGER) AS hour_of_day, CAST({day} AS INTEGER) AS day_of_week,
       CAST(day(time) AS INTEGER) AS day_of_month, CAST(month(time) AS INTEGER) AS month,
       CAST({day} >= 5 AS INTEGER) AS is_weekend,
       {_r(f'sin({TWO_PI} * hour(time) / 24)')} AS hour_sin,
       {_r(f'cos({TWO_PI} * hour(time) / 24)')} AS hour_cos,
       {_r(f'sin({TWO_PI} * {day} / 7)')} AS day_sin,
       {_r(f'cos({TWO_PI} * {day} / 7)')} AS day_cos,
       {rolling}, {_tou("hour(time)")}, {lags}
FROM rolled WINDOW w2 AS ({over})"""


def _split(partition: str, nested: bool) -> str:
    validation = (
        "WHEN pos >= floor(floor(n * CAST(0.8 AS DOUBLE)) * CAST(0.85 AS DOUBLE)) "
        "THEN 'validation'"
        if nested
        else ""
    )
    return f"""placed AS (
  SELECT *, row_number() OVER ({partition} ORDER BY time, event_id) - 1 AS pos,
         CAST(count(*) OVER ({partition}) AS DOUBLE) AS n FROM readings),
labelled AS (
  SELECT *, CASE WHEN pos >= floor(n * CAST(0.8 AS DOUBLE)) THEN 'test' {validation}
            ELSE 'train' END AS split FROM placed)"""


def _rolling(n: int, partition: str, key: str) -> str:
    return f"""WITH {READINGS}
SELECT event_id, {key},
       CASE WHEN count(metric_value) OVER w = {n}
            THEN round(avg(metric_value) OVER w, 4) END AS rolling_avg,
       CASE WHEN count(metric_value) OVER w = {n}
            THEN round(stddev_samp(metric_value) OVER w, 4) END AS rolling_std
FROM readings
WINDOW w AS ({partition} ORDER BY time, event_id
             ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"""


def _runs(length: int, ahead: int, stride: int, more: str = "") -> str:
    return f"""WITH {READINGS},
placed AS (
  SELECT *, CAST(hour(time) AS DOUBLE) AS hour,
         row_number() OVER ({SERIES}) - 1 AS pos,
         count(*) OVER (PARTITION BY site_id, device_id) AS n FROM readings),
runs AS (
  SELECT device_id, pos, n, lead(time, {length - 1}) OVER s AS time,
         metric_value AS first_value,
         lead(metric_value, {length - 1}) OVER s AS last_value,
         lead(hour, {length - 1}) OVER s AS last_hour,
         sum(metric_value) OVER (s ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)
           AS value_sum,
         lead(metric_value, {length - 1 + ahead}) OVER s AS y,
         lead(event_id, {length - 1 + ahead}) OVER s AS y_event
  FROM placed WINDOW s AS ({SERIES}))
SELECT device_id, time, {length} AS run_rows, round(first_value, 4) AS first_value,
       round(last_value, 4) AS last_value, round(last_hour, 4) AS last_hour,
       round(value_sum, 2) AS value_sum, y
FROM runs WHERE pos + {length + ahead} <= n AND pos % {stride} = 0 {more}"""


FRAME = (
    READINGS
    + f""",
rolled AS (
  SELECT *, count(metric_value) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c,
         lag(metric_value) OVER w AS lag_1, lead(metric_value) OVER w AS label
  FROM readings WINDOW w AS ({SERIES})),
frame AS (SELECT *, c = 6 AND lag_1 IS NOT NULL AND metric_value IS NOT NULL AS whole FROM rolled),
frame_placed AS (
  SELECT *, row_number() OVER ({SERIES}) - 1 AS pos,
         CAST(count(*) OVER (PARTITION BY site_id, device_id) AS DOUBLE) AS n
  FROM frame WHERE whole AND label IS NOT NULL),
split_rows AS (
  SELECT *, CASE WHEN pos >= floor(n * CAST(0.8 AS DOUBLE)) THEN 'test' ELSE 'train' END
         AS split FROM frame_placed)"""
)

CLOCKED = """
counted AS (
  SELECT event_id, user_id % 3 AS device, value,
         row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS place
  FROM events),
clocked AS (
  SELECT TIMESTAMP '2024-01-01' + to_minutes(place * step) AS time,
         CASE WHEN step = 5 THEN 'site-0' ELSE 'site-1' END AS site_id,
         'device-' || device AS device_id, value AS metric_value, event_id,
         360 // step AS six, 60 // step AS back, greatest(1, 120 // step) AS ahead
  FROM (SELECT *, CASE device WHEN 0 THEN 5 WHEN 1 THEN 15 ELSE 120 END AS step FROM counted))"""

UNUSUAL = """
counted AS (
  SELECT event_id, user_id % 4 AS device, value,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS place
  FROM events),
unusual AS (
  SELECT TIMESTAMP '2024-01-01' + to_microseconds((place + place // 10) * step) AS time,
         'device-' || device AS device_id, value AS metric_value, event_id
  FROM (SELECT *, CASE device WHEN 0 THEN 500000 WHEN 1 THEN 10000000 WHEN 2 THEN 420000000
                   ELSE 2700000000 END AS step FROM counted))"""

PAIRS = """
pairs AS (
  SELECT * FROM (
    SELECT o_orderpriority AS target, o_totalprice AS actual,
           lag(o_totalprice) OVER (PARTITION BY o_custkey
                                   ORDER BY o_orderdate, o_orderkey) AS predicted
    FROM orders)
  WHERE predicted IS NOT NULL)"""


def _metric_columns(limit: float) -> str:
    return f"""
  avg(abs(actual - predicted)) AS mae,
  sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
  1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(actual))
    AS r2,
  avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100 AS mape,
  avg(actual) AS target_mean,
  avg(abs(actual - predicted)) / avg(actual) * 100 AS mae_percent,
  avg(abs(actual - predicted)) / avg(actual) * 100 <= {limit} AS meets_target"""


ROUNDED_METRICS = ", ".join(
    f"{_r(m)} AS {m}"
    for m in ("mae", "rmse", "r2", "mape", "target_mean", "mae_percent")
)

ORACLE: dict[str, str] = {
    # --- points and readings
    "snapshot_explode": f"""WITH {SNAP_POINTS}
SELECT time, device_id, measurement, time_of_use_period, field, value FROM snap_points""",
    "net_grid_flow": f"""WITH {SNAPSHOTS}
SELECT time AS timestamp, device_id, round(system_net_grid_flow_kw, 4) AS net_grid_flow_kw
FROM snap""",
    "rounded_snapshot": f"""WITH {SNAPSHOTS}
SELECT event_id, device_id, round_even(solar_generation_kw, 3) AS generation_kw,
       round_even(solar_irradiance_w_m2, 2) AS irradiance_w_m2,
       round_even(battery_power_kw, 3) AS power_kw, battery_cycles AS cycles,
       round_even(home_load_appliances_kw, 3) AS appliances_kw,
       round_even(grid_price_price_per_kwh, 4) AS price_per_kwh,
       period AS time_of_use_period FROM snap""",
    "readings_melt": f"""WITH {POINTS}
SELECT time, site_id, coalesce(device_id, 'unknown') AS device_id,
       measurement || '.' || field AS metric_name, try_cast(value AS DOUBLE) AS metric_value
FROM points WHERE try_cast(value AS DOUBLE) IS NOT NULL""",
    "readings_default_device": f"""WITH {POINTS}
SELECT 'home' AS site_id, coalesce(device_id, 'unknown') AS device_id,
       count(*) AS readings, max(time) AS last_time
FROM points WHERE try_cast(value AS DOUBLE) IS NOT NULL GROUP BY 1, 2""",
    "readings_try_cast": f"""WITH {POINTS}
SELECT event_id, try_cast(value AS DOUBLE) AS metric_value FROM points
WHERE try_cast(value AS DOUBLE) IS NOT NULL""",
    "snapshot_readings": f"""WITH {SNAP_POINTS}
SELECT site_id, device_id, measurement || '.' || field AS metric_name,
       count(*) AS readings, round(sum(value), 4) AS total
FROM snap_points GROUP BY ALL""",
    "union_measurements": f"""WITH {POINTS}
SELECT * FROM points WHERE measurement = 'solar'
UNION ALL SELECT * FROM points WHERE measurement = 'battery'
UNION ALL SELECT * FROM points WHERE measurement = 'home_load'
UNION ALL SELECT * FROM points WHERE measurement = 'grid_price'""",
    # --- scans
    "range_scan_site": f"""WITH {READINGS}
SELECT * FROM readings WHERE site_id = 'site-1'
  AND time BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20 12:00:00'""",
    "range_scan_ordered": f"""WITH {READINGS}
SELECT * FROM readings WHERE time >= TIMESTAMP '2024-01-08'
ORDER BY time, event_id LIMIT 5000""",
    "page_offset": f"""WITH {READINGS}
SELECT * FROM readings ORDER BY time, event_id LIMIT 1000 OFFSET 2000""",
    "page_deep": f"""WITH {READINGS}
SELECT * FROM readings ORDER BY time, event_id
LIMIT 50 OFFSET (SELECT count(*) * 9 // 10 // 50 * 50 FROM events)""",
    "series_cursors": f"""WITH {POINTS}
SELECT * EXCLUDE (rn), CAST((rn - 1) // 40 + 1 AS INTEGER) AS round FROM (
  SELECT *, row_number() OVER (PARTITION BY measurement, device_id, field
                               ORDER BY time, event_id) AS rn
  FROM points WHERE time >= TIMESTAMP '2024-01-04') WHERE rn <= 120""",
    "quarantine": f"""WITH {SNAPSHOTS}
SELECT 26 * count(*) FILTER (WHERE event_id % 5 <> 0) AS total_synced,
       count(*) FILTER (WHERE event_id % 5 = 0) AS failed, CAST(0 AS BIGINT) AS pending,
       count(*) FILTER (WHERE event_id % 5 = 0) AS quarantined,
       count(*) FILTER (WHERE event_id % 10 = 5) AS words,
       26 * count(*) FILTER (WHERE event_id % 5 <> 0) AS readings
FROM snap""",
    "sequence_forecast_long": f"""WITH {READINGS},
counted AS (SELECT site_id, CAST(greatest(count(*) - 288, 0) AS DOUBLE) AS n FROM readings GROUP BY ALL),
parts AS (
  SELECT n, floor(n * CAST(0.8 AS DOUBLE)) AS fitting,
         floor(floor(n * CAST(0.8 AS DOUBLE)) * CAST(0.85 AS DOUBLE)) AS train FROM counted)
SELECT CAST(sum(train) AS BIGINT) AS train, CAST(sum(fitting - train) AS BIGINT) AS validation,
       CAST(sum(n - fitting) AS BIGINT) AS test, true AS residuals_cancel,
       true AS residuals_stand_apart, true AS rows_stored_little
FROM parts""",
    "early_stopping": f"""WITH {READINGS},
counted AS (
  SELECT site_id, device_id, CAST(greatest(count(*) - 8, 0) AS DOUBLE) AS n FROM readings GROUP BY ALL),
parts AS (
  SELECT n, floor(n * CAST(0.8 AS DOUBLE)) AS fitting,
         floor(floor(n * CAST(0.8 AS DOUBLE)) * CAST(0.85 AS DOUBLE)) AS train FROM counted)
SELECT CAST(sum(train) AS BIGINT) AS train, CAST(sum(fitting - train) AS BIGINT) AS validation,
       CAST(sum(n - fitting) AS BIGINT) AS test, true AS best_is_least, true AS stopped_in_time,
       true AS best_is_kept, CAST(2 AS INTEGER) AS scaled
FROM parts""",
    "incremental_since": f"""WITH {POINTS}
SELECT * FROM points WHERE time >= TIMESTAMP '2024-01-22 06:00:00'""",
    "incremental_first_run": f"""WITH {POINTS}
SELECT * FROM points WHERE time >= TIMESTAMP '2024-01-30'""",
    "per_series_limit": f"""WITH {POINTS}
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY measurement, device_id, field
                               ORDER BY time, event_id) AS rn
  FROM points WHERE time >= TIMESTAMP '2024-01-04') WHERE rn <= 3""",
    "table_stats": """SELECT count(*) AS total_records, min(ts) AS earliest_time,
       max(ts) AS latest_time FROM events""",
    "latest_row": f"""WITH {READINGS}
SELECT site_id, min(time) AS earliest_time, arg_min(metric_value, time) AS earliest_value,
       max(time) AS latest_time, arg_max(metric_value, time) AS latest_value
FROM readings GROUP BY site_id""",
    "month_partition_scan": """
SELECT strftime(o_orderdate, '%Y-%m') AS month,
       'site-' || CAST(o_custkey % 3 AS VARCHAR) AS site_id,
       count(*) AS readings, round(sum(o_totalprice), 4) AS total
FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-02-10' AND TIMESTAMP '1998-11-20'
GROUP BY 1, 2""",
    "retention_compaction": """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS readings,
       min(o_orderdate) AS first_time
FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-10' - INTERVAL 900 DAY
GROUP BY 1""",
    "points_sink": f"""WITH {SNAP_POINTS}
SELECT device_id, field, count(*) AS points, round(sum(value), 4) AS total
FROM snap_points WHERE measurement = 'battery' GROUP BY ALL""",
    "snapshot_round_trip": f"""WITH {SNAPSHOTS}
SELECT time AS timestamp, device_id, round(battery_soc_percent, 2) AS soc_percent,
       battery_cycles AS cycles, round(home_load_appliances_kw, 3) AS appliances_kw,
       period AS time_of_use_period, round(battery_power_kw, 3) AS battery_kw
FROM snap""",
    "retention_filter": f"""WITH {READINGS}
SELECT * FROM readings WHERE time >= TIMESTAMP '2024-01-24'""",
    # --- duplicates, pivot, upsert
    "duplicate_groups": f"""WITH {VERSIONS}
SELECT time, site_id, device_id, metric_name, count(*) AS copies
FROM versions GROUP BY ALL HAVING count(*) > 1""",
    "duplicate_count": f"""WITH {VERSIONS},
groups AS (SELECT time, site_id, device_id, metric_name, count(*) AS copies
           FROM versions GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS duplicated_keys, CAST(sum(copies) AS BIGINT) AS copies FROM groups""",
    "pivot_wide": f"""WITH {VERSIONS},
firsts AS (SELECT * FROM versions WHERE version = 1)
SELECT time, site_id, device_id,
  max(CASE WHEN metric_name = 'solar.generation_kw' THEN metric_value END)
    AS solar_generation_kw,
  max(CASE WHEN metric_name = 'home_load.total_load_kw' THEN metric_value END)
    AS home_load_total_load_kw,
  max(CASE WHEN metric_name = 'battery.power_kw' THEN metric_value END)
    AS battery_power_kw,
  max(CASE WHEN metric_name = 'battery.soc_percent' THEN metric_value END)
    AS battery_soc_percent,
  max(CASE WHEN metric_name = 'grid_price.price_per_kwh' THEN metric_value END)
    AS grid_price_price_per_kwh
FROM firsts GROUP BY time, site_id, device_id""",
    "pivot_snapshots": f"""WITH {SNAPSHOTS}
SELECT time, site_id, device_id, {", ".join(METRICS)} FROM snap""",
    "upsert_latest": f"""WITH {LATEST}
SELECT time, site_id, device_id, metric_name, metric_value, version FROM latest""",
    "append_and_compact": f"""WITH {LATEST}
SELECT time, site_id, device_id, metric_name, metric_value, version FROM latest""",
    # --- projections
    "null_clean": """SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN value END
       AS metric_value FROM events""",
    "schema_projection": f"""WITH {READINGS}
SELECT time, site_id, device_id,
  CASE WHEN metric_name = 'solar.generation_kw' THEN metric_value END
    AS "solar.generation_kw",
  CASE WHEN metric_name = 'battery.soc_percent' THEN metric_value END
    AS "battery.soc_percent",
  CASE WHEN metric_name = 'battery.power_kw' THEN metric_value END AS "battery.power_kw",
  CASE WHEN metric_name = 'home_load.total_load_kw' THEN metric_value END
    AS "home_load.total_load_kw",
  CASE WHEN metric_name = 'grid_price.price_per_kwh' THEN metric_value END
    AS "grid_price.price_per_kwh"
FROM readings""",
    "training_view": f"""WITH {READINGS}
SELECT site_id,
  count(*) FILTER (WHERE metric_name = 'solar.generation_kw') AS solar_rows,
  round(avg(metric_value) FILTER (WHERE metric_name = 'solar.generation_kw'), 4)
    AS mean_solar_kw,
  round(avg(metric_value) FILTER (WHERE metric_name = 'home_load.total_load_kw'), 4)
    AS mean_load_kw,
  max(metric_value) FILTER (WHERE metric_name = 'grid_price.price_per_kwh') AS top_price
FROM readings GROUP BY site_id""",
    "feature_requirements": f"""WITH {READINGS},
names AS (SELECT unnest({METRICS!r}) AS feature),
found AS (SELECT DISTINCT replace(metric_name, '.', '_') AS feature FROM readings)
SELECT names.feature, found.feature IS NOT NULL AS available, found.feature IS NULL AS refused,
       (SELECT count(*) FROM (SELECT DISTINCT time, site_id, device_id FROM readings)) AS wide_rows
FROM names LEFT JOIN found ON found.feature = names.feature""",
    "iso_time": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso_time,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339_time FROM events""",
    "parse_time": """SELECT event_id,
  CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts)
       WHEN 1 THEN date_trunc('second', ts) + INTERVAL 8 HOUR END AS parsed_time
FROM events""",
    # --- calendar and time of use
    "temporal_features": """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day,
       CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month,
       CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events""",
    "cyclic_features": f"""
SELECT event_id, round(sin({TWO_PI} * hour(ts) / 24), 4) + 0 AS hour_sin,
       round(cos({TWO_PI} * hour(ts) / 24), 4) + 0 AS hour_cos,
       round(sin({TWO_PI} * (isodow(ts) - 1) / 7), 4) + 0 AS day_sin,
       round(cos({TWO_PI} * (isodow(ts) - 1) / 7), 4) + 0 AS day_cos FROM events""",
    "tou_onehot": """
WITH labelled AS (
  SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN
      CASE event_type WHEN 'click' THEN 'peak' WHEN 'error' THEN 'peak'
                      WHEN 'purchase' THEN 'shoulder' ELSE 'off_peak' END
    END AS grid_price_time_of_use_period FROM events)
SELECT *,
  CAST(coalesce(grid_price_time_of_use_period = 'peak', false) AS INTEGER) AS tou_peak,
  CAST(coalesce(grid_price_time_of_use_period = 'off_peak', false) AS INTEGER)
    AS tou_off_peak,
  CAST(coalesce(grid_price_time_of_use_period = 'shoulder', false) AS INTEGER)
    AS tou_shoulder
FROM labelled""",
    "tou_from_hour": f"""
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, {_tou("hour(ts)")} FROM events""",
    "tou_schedule_join": """
SELECT event_id, CASE WHEN hour(ts) >= 16 AND hour(ts) < 21 THEN 'peak'
       WHEN hour(ts) >= 7 AND hour(ts) < 22 THEN 'shoulder' ELSE 'off_peak' END AS period
FROM events""",
    "grid_align": """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS slot, count(*) AS events,
       max(value) AS top_value FROM events GROUP BY 1""",
    "time_spine": """
SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 5 MINUTE)) AS time FROM events""",
    # --- series windows
    "rolling_mean_std": _rolling(12, "PARTITION BY site_id, device_id", "device_id"),
    "rolling_long_window": _rolling(300, "PARTITION BY site_id", "site_id"),
    "rolling_with_nulls": f"""WITH {READINGS},
wide AS (
  SELECT time, site_id, device_id,
         CASE WHEN metric_name = 'solar.generation_kw' THEN metric_value END AS solar
  FROM readings)
SELECT time, device_id,
       CASE WHEN count(solar) OVER w = 2 THEN round(avg(solar) OVER w, 4) END AS rolling_avg,
       CASE WHEN count(solar) OVER w = 2 THEN round(stddev_samp(solar) OVER w, 4) END
         AS rolling_std
FROM wide WINDOW w AS (PARTITION BY site_id, device_id ORDER BY time
                       ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
    "lag_features": f"""WITH {READINGS}
SELECT event_id, device_id, lag(metric_value, 1) OVER ({SERIES}) AS lag_1,
       lag(metric_value, 12) OVER ({SERIES}) AS lag_1h, CAST(NULL AS DOUBLE) AS lag_0
FROM readings""",
    "interarrival": f"""WITH {READINGS}
SELECT event_id, device_id,
       epoch_us(time) - lag(epoch_us(time)) OVER ({SERIES}) AS gap_micros FROM readings""",
    "median_interval": f"""WITH {READINGS}
SELECT median(gap) AS median_micros FROM (
  SELECT epoch_us(time) - lag(epoch_us(time)) OVER ({SERIES}) AS gap FROM readings)""",
    "lead_target": f"""WITH {READINGS}
SELECT * FROM (
  SELECT event_id, device_id, metric_value,
         lead(metric_value, 24) OVER ({SERIES}) AS label FROM readings)
WHERE label IS NOT NULL""",
    "chrono_split": f"""WITH {READINGS},
{_split("PARTITION BY site_id, device_id", False)}
SELECT event_id, split FROM labelled""",
    "global_split": f"""WITH {READINGS},
{_split("", True)}
SELECT event_id, split FROM labelled""",
    "nested_split": f"""WITH {READINGS},
{_split("PARTITION BY site_id, device_id", True)}
SELECT event_id, device_id, split FROM labelled""",
    "split_counts": f"""WITH {READINGS},
{_split("PARTITION BY site_id, device_id", True)}
SELECT split, count(*) AS samples FROM labelled GROUP BY split""",
    "sequences": _runs(6, 3, 1),
    "strided_sequences": _runs(8, 2, 4),
    "padded_sequences": f"""WITH {READINGS},
placed AS (
  SELECT *, CAST(hour(time) AS DOUBLE) AS hour, row_number() OVER ({SERIES}) AS pos,
         count(*) OVER (PARTITION BY site_id, device_id) AS n,
         sum(metric_value) OVER ({SERIES} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)
           AS value_sum,
         lag(metric_value, 63) OVER ({SERIES}) AS before FROM readings)
SELECT device_id, time, 64 AS run_rows,
       CASE WHEN pos >= 64 THEN round(before, 4) ELSE 0 END AS first_value,
       round(metric_value, 4) AS last_value, round(hour, 4) AS last_hour,
       round(value_sum, 2) AS value_sum
FROM placed WHERE pos >= 64 OR pos = n""",
    "scale_features": """
WITH stats AS (
  SELECT avg(value) AS mv, stddev_pop(value) AS sv,
         avg(CAST(hour(ts) AS DOUBLE)) AS mh, stddev_pop(CAST(hour(ts) AS DOUBLE)) AS sh
  FROM events)
SELECT event_id, round((value - mv) / sv, 4) AS metric_value,
       round((hour(ts) - mh) / sh, 4) AS hour, CAST(0 AS DOUBLE) AS constant
FROM events, stats""",
    # --- metrics
    "forecast_metrics": f"""WITH {PAIRS},
m AS (SELECT target, {_metric_columns(10)} FROM pairs GROUP BY target)
SELECT target, {ROUNDED_METRICS}, meets_target FROM m""",
    "forecast_metrics_total": f"""WITH {PAIRS},
m AS (SELECT {_metric_columns(100)} FROM pairs)
SELECT {ROUNDED_METRICS}, meets_target FROM m""",
    "compare_models": f"""WITH {PAIRS},
shrunk AS (SELECT target, actual, predicted * CAST(0.5 AS DOUBLE) + 125000 AS predicted
           FROM pairs WHERE target <> '5-LOW'),
b AS (SELECT target, {_metric_columns(10)} FROM pairs GROUP BY target),
c AS (SELECT target, {_metric_columns(5)} FROM shrunk GROUP BY target)
SELECT target, {_r('b.mae')} AS baseline_mae, {_r('b.rmse')} AS baseline_rmse,
       {_r('b.r2')} AS baseline_r2, {_r('c.mae')} AS candidate_mae,
       {_r('c.rmse')} AS candidate_rmse, {_r('c.r2')} AS candidate_r2,
       {_r('(b.mae - c.mae) / b.mae * 100')} AS mae_percent_improvement,
       {_r('(b.rmse - c.rmse) / b.rmse * 100')} AS rmse_percent_improvement,
       {_r('c.r2 - b.r2')} AS r2_absolute_improvement,
       c.mae_percent <= 40 AS meets_target,
       c.mae < b.mae AND c.r2 > b.r2 AS is_better
FROM b JOIN c USING (target)""",
    "best_epoch": """
WITH days AS (
  SELECT CAST(day(ts) AS INTEGER) AS epoch,
         coalesce(avg(value) FILTER (WHERE event_type = 'view'),
                  avg(value) FILTER (WHERE event_type = 'click')) AS loss
  FROM events GROUP BY 1)
SELECT (SELECT epoch FROM days ORDER BY loss, epoch LIMIT 1) AS best_epoch,
       count(*) AS total_epochs FROM days""",
    # --- parts, durations, running totals
    "load_quality": f"""WITH {SNAPSHOTS}
SELECT site_id, count(*) FILTER (WHERE event_id % 11 <> 0) AS consistent,
       count(*) AS rows FROM snap GROUP BY site_id""",
    "sample_duration": f"""WITH {READINGS}
SELECT event_id, device_id, round(coalesce(
         epoch_us(time) - lag(epoch_us(time)) OVER ({SERIES}), 300000000) / 3600000000.0, 4)
         AS hours
FROM readings""",
    "throughput_cycles": f"""WITH {SNAPSHOTS},
timed AS (SELECT *, coalesce(epoch_us(time) - lag(epoch_us(time)) OVER ({SERIES}),
                  300000000) / {D(3600000000)} AS hours FROM snap),
total AS (SELECT *, sum(abs(battery_power_kw * hours)) OVER ({SERIES}
                  ROWS UNBOUNDED PRECEDING) AS kwh FROM timed)
SELECT event_id, {_r("kwh")} AS throughput_kwh,
       CAST(floor(kwh / {D(13.5)}) AS BIGINT) AS cycles FROM total""",
    # --- whole jobs
    "feature_build": _feature_build(7, "PARTITION BY site_id, device_id", ""),
    "feature_build_exact": _feature_build(
        1, "PARTITION BY site_id, device_id", "", exact=True
    ),
    "feature_build_mixed": _feature_build(1, "", ", site_id, device_id"),
    "stream_sync_upsert": f"""WITH {LATEST}
SELECT time, site_id, device_id, metric_name, metric_value FROM latest""",
    "sync_then_features": f"""WITH {LATEST},
wide AS (
  SELECT time, site_id, device_id,
         max(CASE WHEN metric_name = 'solar.generation_kw' THEN metric_value END)
           AS solar_generation_kw,
         max(CASE WHEN metric_name = 'home_load.total_load_kw' THEN metric_value END)
           AS home_load_total_load_kw
  FROM latest GROUP BY ALL)
SELECT *, lag(home_load_total_load_kw) OVER (PARTITION BY site_id, device_id ORDER BY time)
         AS load_lag_1 FROM wide""",
    "sync_status": """
SELECT max(ts) AS last_sync_time, count(*) AS last_sync_count, count(*) AS total_synced,
       CAST(1 AS BIGINT) AS batches, CAST(0 AS BIGINT) AS open_batches,
       2 * count(*) AS failed, CAST(0 AS BIGINT) AS pending FROM events""",
    "fan_out": f"""WITH {SNAP_POINTS}
SELECT 'snapshots' AS sink, device_id, count(*) AS rows FROM snap GROUP BY ALL
UNION ALL
SELECT measurement || '.' || field, device_id, count(*) FROM snap_points GROUP BY ALL""",
    "changes_only": f"""WITH {READINGS},
arrivals AS (
  SELECT *, unnest([0, 2, 3]) AS step FROM readings
  UNION ALL
  SELECT time, site_id, device_id, metric_name, metric_value + 1, event_id, 1
  FROM readings WHERE event_id % 10 = 0),
seen AS (
  SELECT *, lag(metric_value) OVER w AS last_value, row_number() OVER w AS n FROM arrivals
  WINDOW w AS (PARTITION BY time, site_id, device_id, metric_name ORDER BY step, event_id))
SELECT * EXCLUDE (last_value, n) FROM seen WHERE n = 1 OR metric_value IS DISTINCT FROM last_value""",
    "two_checkpoints": f"""WITH {READINGS}
SELECT * EXCLUDE (event_id) REPLACE (
  metric_value + CASE WHEN event_id % 20 = 0 THEN 5 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS metric_value)
FROM readings""",
    "compact_ties": f"""WITH {READINGS}
SELECT time, site_id, device_id, metric_name, metric_value - 1 AS metric_value,
  unnest(['before', 'after']) AS moment
FROM readings""",
    "interrupted_replacement": f"""WITH {LATEST}
SELECT *, unnest(['written', 'committed', 'moved']) AS moment FROM versions WHERE version = 1
UNION ALL
SELECT *, unnest(['switched', 'dropped', 'finished']) AS moment FROM latest""",
    "stream_drop_repeats": f"""WITH {VERSIONS}
SELECT time, site_id, device_id, metric_name, metric_value FROM versions""",
    "run_summary": f"""WITH built AS (
{_feature_build(7, "PARTITION BY site_id, device_id", "")})
SELECT 'success' AS status, count(*) AS records_processed, count(*) AS records_stored,
       CAST(49 AS INTEGER) AS features_count FROM built""",
    "periodic_features": f"""WITH built AS (
{_feature_build(7, "PARTITION BY site_id, device_id", "")})
SELECT count(*) AS total_records, min(time) AS earliest_time, max(time) AS latest_time
FROM built""",
    "incremental_features": f"""WITH built AS (
{_feature_build(1, "PARTITION BY site_id, device_id", "", exact=True)}),
devices AS (SELECT DISTINCT user_id % 3 AS site, user_id FROM events)
SELECT count(*) AS total_records, min(time) AS earliest_time, max(time) AS latest_time,
       (SELECT count(*) FROM devices WHERE user_id % 5 <> 0) AS series_1,
       (SELECT count(*) FROM devices WHERE user_id % 5 <= 1) AS series_2, CAST(0 AS BIGINT) AS series_3
FROM built""",
    "gbt_forecast": f"""WITH {FRAME},
counts AS (
  SELECT count(*) FILTER (WHERE split = 'train') AS train,
         count(*) FILTER (WHERE split = 'test') AS test FROM split_rows),
missing AS (
  SELECT count(*) AS left_out FROM frame WHERE label IS NOT NULL AND NOT whole)
SELECT device_id, count(*) FILTER (WHERE whole) AS predicted, count(*) AS rows,
       any_value(train) AS train, any_value(test) AS test, any_value(left_out) AS left_out
FROM frame, counts, missing GROUP BY device_id""",
    "stored_model_metrics": f"""WITH {FRAME}
SELECT 'load' AS target, true AS metrics_agree,
       count(*) FILTER (WHERE split = 'test') AS equal_predictions FROM split_rows""",
    "feature_importance": """
SELECT CAST(5 AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, true AS falling""",
    "sequence_forecast": f"""WITH {READINGS},
runs AS (
  SELECT time, event_id, site_id, device_id, metric_value AS x,
         lead(metric_value) OVER ({SERIES}) AS y FROM readings),
placed AS (
  SELECT *, row_number() OVER ({SERIES}) - 1 AS pos,
         CAST(count(*) OVER (PARTITION BY site_id, device_id) AS DOUBLE) AS n
  FROM runs WHERE y IS NOT NULL),
cut AS (
  SELECT *, CASE WHEN pos >= floor(n * CAST(0.8 AS DOUBLE)) THEN 'test'
                 WHEN pos >= floor(floor(n * CAST(0.8 AS DOUBLE)) * CAST(0.85 AS DOUBLE))
                 THEN 'validation' ELSE 'train' END AS split FROM placed),
line AS (
  SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
  FROM cut WHERE split = 'train')
SELECT count(*) FILTER (WHERE split = 'train') AS train,
       count(*) FILTER (WHERE split = 'validation') AS validation,
       count(*) FILTER (WHERE split = 'test') AS test,
       {_r("any_value(slope)")} AS slope, {_r("any_value(intercept)")} AS intercept,
       {_r("avg(abs(y - slope * x - intercept)) FILTER (WHERE split = 'test')")} AS mae
FROM cut, line""",
    "training_job": f"""WITH {CLOCKED},
targets AS (
  SELECT 'load' AS target, *, metric_value AS v FROM clocked WHERE site_id = 'site-1'
  UNION ALL
  SELECT 'solar', *, CASE WHEN event_id % 10 <> 0 THEN metric_value END
  FROM clocked WHERE site_id = 'site-1'),
labelled AS (
  SELECT target, device_id, time, lead(v, ahead) OVER (
           PARTITION BY target, device_id ORDER BY time) AS label FROM targets),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY target, device_id ORDER BY time) - 1 AS pos,
         CAST(count(*) OVER (PARTITION BY target, device_id) AS DOUBLE) AS n
  FROM labelled WHERE label IS NOT NULL)
SELECT target, 'success' AS status, CAST(1 AS INTEGER) AS features,
       count(*) FILTER (WHERE pos < floor(n * CAST(0.8 AS DOUBLE))) AS train,
       count(*) FILTER (WHERE pos >= floor(n * CAST(0.8 AS DOUBLE))) AS test
FROM placed GROUP BY target""",
    "interval_classes": f"""WITH {CLOCKED},
built AS (
  SELECT event_id, device_id, six,
         count(metric_value) OVER w AS c, avg(metric_value) OVER w AS a,
         stddev_samp(metric_value) OVER w AS s,
         CASE WHEN back > 0 THEN lag(metric_value, back) OVER s END AS lag_1h,
         lead(metric_value, ahead) OVER s AS label
  FROM clocked
  WINDOW s AS (PARTITION BY device_id ORDER BY time),
         w AS (PARTITION BY device_id ORDER BY time ROWS BETWEEN (six - 1) PRECEDING AND CURRENT ROW))
SELECT event_id, device_id, CASE WHEN c = six THEN {_r("a")} END AS rolling_avg,
       CASE WHEN c = six THEN {_r("s")} END AS rolling_std,
       {_r("lag_1h")} AS lag_1h, {_r("label")} AS label
FROM built WHERE label IS NOT NULL""",
    "exact_intervals": f"""WITH {UNUSUAL},
gaps AS (
  SELECT device_id, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY device_id ORDER BY time) AS gap
  FROM unusual),
medians AS (SELECT device_id, median(gap) AS micros FROM gaps GROUP BY device_id),
sized AS (
  SELECT unusual.*, micros,
         greatest(1, CAST(round_even(1200e6 / micros, 0) AS BIGINT)) AS n,
         CAST(round_even(600e6 / micros, 0) AS BIGINT) AS back,
         greatest(1, CAST(round_even(900e6 / micros, 0) AS BIGINT)) AS ahead
  FROM unusual JOIN medians USING (device_id)),
built AS (
  SELECT *, count(metric_value) OVER w AS c, avg(metric_value) OVER w AS a,
         stddev_samp(metric_value) OVER w AS s,
         CASE WHEN back > 0 THEN lag(metric_value, back) OVER line END AS lagged,
         lead(metric_value, ahead) OVER line AS label
  FROM sized
  WINDOW line AS (PARTITION BY device_id ORDER BY time),
         w AS (PARTITION BY device_id ORDER BY time ROWS BETWEEN (n - 1) PRECEDING AND CURRENT ROW))
SELECT event_id, device_id, micros AS interval_micros, n AS window_rows,
       CASE WHEN c = n THEN {_r("a")} END AS rolling_avg,
       CASE WHEN c = n THEN {_r("s")} END AS rolling_std,
       {_r("lagged")} AS lagged, {_r("label")} AS label
FROM built""",
    "median_by_series": f"""WITH {READINGS},
gaps AS (
  SELECT site_id, device_id, epoch_us(time) - lag(epoch_us(time)) OVER ({SERIES}) AS gap FROM readings)
SELECT site_id, device_id, count(*) AS series_rows, median(gap) AS interval_micros
FROM gaps GROUP BY site_id, device_id""",
    "rolling_cut": _rolling(30, "PARTITION BY site_id", "site_id"),
    "lag_lead_cut": f"""WITH {READINGS},
named AS (SELECT * REPLACE (nullif(site_id, 'site-2') AS site_id) FROM readings)
SELECT event_id, site_id, lag(metric_value, 7) OVER s AS lag_7,
       lead(metric_value, 9) OVER s AS lead_9
FROM named WINDOW s AS (PARTITION BY site_id ORDER BY time, event_id)""",
    "split_cut": f"""WITH {READINGS},
{_split("", True)}
SELECT event_id, split FROM labelled""",
    "running_total_cut": f"""WITH {READINGS}
SELECT event_id, site_id, {_r("sum(metric_value) OVER (PARTITION BY site_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)")} AS total
FROM readings""",
    "first_rows_cut": f"""WITH {READINGS}
SELECT event_id, site_id FROM readings
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY time, event_id) <= 1200""",
    "page_after": f"""WITH {READINGS}
SELECT * FROM readings WHERE time >= TIMESTAMP '2024-01-12 06:30:00'
ORDER BY time, event_id LIMIT 1000""",
    "nan_targets": _runs(6, 3, 1, "AND y_event % 9 NOT IN (0, 4)"),
    "zero_actuals": f"""WITH zeroed AS (
  SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice ELSE 0 END AS actual,
         lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
           AS predicted FROM orders),
pairs AS (SELECT * FROM zeroed WHERE predicted IS NOT NULL),
m AS (SELECT {_metric_columns(100)} FROM pairs)
SELECT {ROUNDED_METRICS}, meets_target FROM m""",
    "training_table_stats": f"""WITH built AS (
{_feature_build(7, "PARTITION BY site_id, device_id", "")})
SELECT count(*) AS total_records, min(time) AS earliest_time, max(time) AS latest_time
FROM built""",
    "stream_snapshot_sync": f"""WITH {SNAP_POINTS}
SELECT 'edge-gateway-site' AS site_id, measurement || '.' || field AS metric_name,
       count(*) AS readings, round(avg(value), 1) + 0 AS mean_value
FROM snap_points GROUP BY ALL""",
}
