"""Value cleaning and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(col: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(col) | col.isin(float("inf"), float("-inf"))
    return F.when(~bad, col)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply `finite` to every float and double column."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            finite(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def round_half_even(value: Column, places: int) -> Column:
    """Round the exact binary value to `places` decimals, true ties to even.

    `bround` rounds the shortest decimal text of a double, so that 0.0015 counts
    as a tie although the number is above it.  Here the product with 10^places
    is split into its rounded value and the exact rest, which decides such cases.
    """
    scale = float(10**places)
    product = value * scale
    split = value * 134217729.0  # 2^27 + 1: halves the 53 bits of the mantissa
    high = split - (split - value)
    rest = (high * scale - product) + (value - high) * scale
    half = product - F.floor(product) == 0.5
    whole = (
        F.when(half & (rest > 0), F.ceil(product).cast("double"))
        .when(half & (rest < 0), F.floor(product).cast("double"))
        .otherwise(F.rint(product))
    )
    return whole / scale


def iso_seconds(time: Column) -> Column:
    """ISO-8601 text in whole seconds with a +00:00 offset (UTC session)."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def rfc3339(time: Column) -> Column:
    """RFC 3339 text in UTC with a Z (UTC session)."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(text: Column) -> Column:
    """Timestamp of ISO text with Z or offset; null where it is none."""
    return F.try_to_timestamp(text)


def to_number(value: Column) -> Column:
    """Finite double of any value; null where it is none."""
    return finite(value.try_cast("double"))
