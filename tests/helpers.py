"""Series for the tests and their answers in plain pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd

KEYS = ["site_id", "device_id"]
ORDER = ["time", "row_id"]


def skewed_series(rows: int = 600, seed: int = 0) -> pd.DataFrame:
    """Several devices, one with a third of all rows.

    A burst within a millisecond, a long gap and missing values are included.
    """
    rng = np.random.default_rng(seed)
    n_hot = rows // 3
    device = np.array(
        ["hot"] * n_hot + [f"d{i % 9}" for i in range(rows - n_hot)], dtype=object
    )
    micros = rng.integers(0, 20 * 86_400_000_000, rows)
    burst = n_hot // 3
    micros[:burst] = 9 * 86_400_000_000 + rng.integers(0, 1000, burst)
    micros[burst : 2 * burst] = 15 * 86_400_000_000 + rng.integers(0, 10**9, burst)
    value = np.round(rng.exponential(50, rows), 2)
    value[rng.random(rows) < 0.02] = np.nan
    pdf = pd.DataFrame(
        {
            "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(micros, unit="us"),
            "site_id": np.where(device == "hot", "s0", "s1"),
            "device_id": device,
            "row_id": np.arange(rows),
            "value": value,
        }
    )
    return pdf.sample(frac=1, random_state=seed).reset_index(drop=True)


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(ORDER, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    """Data frame with missing values as nulls."""
    from energylake.functions.cleaning import nan_to_null

    return nan_to_null(spark.createDataFrame(pdf))


def by_row(df) -> pd.DataFrame:
    return df.toPandas().sort_values("row_id", ignore_index=True)
