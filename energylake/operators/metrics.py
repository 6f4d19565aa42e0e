"""Forecast metrics and the comparison of two forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["mae", "rmse", "r2", "mape", "target_mean", "mae_percent", "meets_target"]


def forecast_metrics(
    df: DataFrame,
    actual: str,
    predicted: str,
    target_mae_percent: float,
    by: Sequence[str] = (),
) -> DataFrame:
    """Error metrics in one pass, over all rows or per group.

    Zero actuals are left out of MAPE; MAE % is relative to the signed mean and
    0 where that is 0.  A constant actual gives R² 1 if it is met, else 0.
    """
    y = F.col(actual).cast("double")
    error = y - F.col(predicted)
    sums = df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        (F.avg(F.when(y != 0, F.abs(error / y))) * 100).alias("_mape"),
        F.avg(y).alias("target_mean"),
    )
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).otherwise(
        F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    )
    mae_percent = F.when(
        F.col("target_mean") != 0, F.col("mae") / F.col("target_mean") * 100
    ).otherwise(0.0)
    return (
        sums.withColumn("r2", r2)
        .withColumn("mape", F.coalesce("_mape", F.lit(0.0)))
        .withColumn("mae_percent", mae_percent)
        .withColumn("meets_target", F.col("mae_percent") <= target_mae_percent)
        .select(*by, *METRICS)
    )


def compare_forecasts(
    candidate: DataFrame,
    baseline: DataFrame,
    target_mae_percent: float = 5.0,
    on: str = "target",
) -> DataFrame:
    """Improvement of a candidate over a baseline, for targets both have."""
    both = candidate.alias("c").join(baseline.alias("b"), on)

    def gain(metric: str):
        base = F.col(f"b.{metric}")
        return F.when(base > 0, (base - F.col(f"c.{metric}")) / base * 100).otherwise(
            0.0
        )

    return both.select(
        on,
        *[F.col(f"b.{m}").alias(f"baseline_{m}") for m in ("mae", "rmse", "r2")],
        *[F.col(f"c.{m}").alias(f"candidate_{m}") for m in ("mae", "rmse", "r2")],
        gain("mae").alias("mae_percent_improvement"),
        gain("rmse").alias("rmse_percent_improvement"),
        (F.col("c.r2") - F.col("b.r2")).alias("r2_absolute_improvement"),
        (F.col("c.mae_percent") <= target_mae_percent).alias("meets_target"),
    ).withColumn(
        "is_better",
        (F.col("mae_percent_improvement") > 0) & (F.col("r2_absolute_improvement") > 0),
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """1-based epoch of the smallest validation (else training) loss."""
    loss = F.coalesce("validation_loss", "train_loss")
    return history.agg(
        F.min_by("epoch", F.struct(loss, "epoch")).alias("best_epoch"),
        F.count(F.lit(1)).alias("total_epochs"),
    )
