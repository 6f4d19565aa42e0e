"""Forecasts of load and solar power with gradient-boosted trees."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..options import ForecastOptions, SequenceOptions
from ..schemas import flat
from ..session import discard, new_path, stage
from ..sources.tables import scan_training_data
from .dataset import (
    Scaler,
    chrono_split,
    horizon_rows,
    lead_by_class,
    lead_target,
    padded_sequences,
    sequences,
    split_counts,
)
from .intervals import horizon_rows as row_horizon
from .intervals import lead_by_interval, lead_column, series_intervals, with_row_counts
from .metrics import METRICS, best_epoch, compare_forecasts, forecast_metrics
from .reshape import normalise_names, select_features
from .runs import LinearRuns, Shape

LEVEL = StorageLevel.MEMORY_AND_DISK


@dataclass
class Forecast:
    """A trained model with what is needed to use and to judge it."""

    target: str
    features: list[str]
    model: PipelineModel
    metrics: dict
    samples: dict[str, int]
    options: dict
    importance: dict[str, float] = field(default_factory=dict)
    scaler: Scaler | None = None
    history: list[dict] = field(default_factory=list)
    best_epoch: int | None = None
    #: rows or runs that lacked a feature and were not used in training
    left_out: int = 0

    def predict(self, df: DataFrame) -> DataFrame:
        """Add `prediction` to a feature frame; dotted names are accepted.

        Sequence models give one row per sequence instead.  Rows and sequences
        that lack a feature have a null prediction.
        """
        df = normalise_names(df)
        if "sequence_length" not in self.options:
            whole = reduce(and_, [F.col(c).isNotNull() for c in self.features])
            return _known(self.model.transform(df.withColumn("_whole", whole)))
        if self.scaler is not None:
            df = self.scaler.transform(df)
        runs = padded_sequences(
            df,
            self.features,
            self.options["sequence_length"],
            self.options["partition_cols"],
            self.options["order"],
        )
        return _known(self.model.transform(_flattened(runs.withColumn("_whole", _complete()))))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        facts = {
            "target": self.target,
            "features": self.features,
            "metrics": self.metrics,
            "samples": self.samples,
            "options": self.options,
            "importance": self.importance,
            "scaler": self.scaler and asdict(self.scaler),
            "history": self.history,
            "best_epoch": self.best_epoch,
            "left_out": self.left_out,
            "saved_at": datetime.now(timezone.utc).isoformat(),
        }
        (
            spark.range(1)
            .select(F.lit(json.dumps(facts)).alias("value"))
            .write.mode("overwrite")
            .text(f"{path}/facts")
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forecast:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        facts.pop("saved_at")
        if facts["scaler"]:
            facts["scaler"] = Scaler(**facts["scaler"])
        return cls(model=PipelineModel.load(f"{path}/model"), **facts)


def _known(predicted: DataFrame) -> DataFrame:
    """Predictions of rows that have all features, null for others."""
    known = F.when(F.col("_whole"), F.col("prediction"))
    return predicted.withColumn("prediction", known).drop("features", "_whole")


def series_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[str]:
    """`order`, and after it the series columns that are no keys, so that nothing ties."""
    more = [c for c in schemas.SERIES if c in df.columns and c not in (*keys, *order)]
    return [*order, *more]


def stored_metrics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Metrics of saved models, one row per target."""
    rows = {
        name: json.loads(spark.read.text(f"{path}/facts").first()[0])["metrics"]
        for name, path in paths.items()
    }
    return metrics_frame(spark, rows)


def metrics_frame(spark: SparkSession, metrics: dict[str, dict]) -> DataFrame:
    schema = "target string, " + ", ".join(
        f"{m} {'boolean' if m == 'meets_target' else 'double'}" for m in METRICS
    )
    rows = [(name, *[m[c] for c in METRICS]) for name, m in metrics.items()]
    return spark.createDataFrame(rows, schema)


def importance_frame(spark: SparkSession, forecast: Forecast) -> DataFrame:
    """Feature importances, largest first."""
    rows = list(forecast.importance.items())
    frame = spark.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


def compare_models(
    spark: SparkSession,
    candidate: dict[str, dict],
    baseline: dict[str, dict],
    target_mae_percent: float = 5.0,
) -> DataFrame:
    """Comparison of two sets of metrics, for the targets both have."""
    return compare_forecasts(
        metrics_frame(spark, candidate),
        metrics_frame(spark, baseline),
        target_mae_percent,
    )


# --- training --------------------------------------------------------------


def _require(rows: int, least: int, what: str) -> None:
    if rows < least:
        raise ValueError(f"Insufficient data: {rows} {what} where training takes {least} or more")


def _regressor(options: ForecastOptions, **more) -> GBTRegressor:
    return GBTRegressor(
        maxIter=more.pop("maxIter", options.n_estimators),
        **more,
        maxDepth=options.max_depth,
        stepSize=options.learning_rate,
        minInstancesPerNode=options.min_samples_leaf,
        seed=options.seed,
    )


def _sorted_importance(names: Sequence[str], model) -> dict[str, float]:
    if not hasattr(model, "featureImportances"):
        return {}
    scores = zip(names, model.featureImportances.toArray().tolist())
    return dict(sorted(scores, key=lambda item: -item[1]))


def _evaluate(scored: DataFrame, options: ForecastOptions) -> dict:
    return (
        forecast_metrics(scored, "label", "prediction", options.target_mae_percent)
        .first()
        .asDict()
    )


def _counts(df: DataFrame) -> dict[str, int]:
    return {r["split"]: r["samples"] for r in split_counts(df).collect()}


def train_forecast(
    df: DataFrame,
    target: str,
    options: ForecastOptions | None = None,
    rows_ahead: int | None = None,
    features: Sequence[str] | None = None,
    order: Sequence[str] = ("time",),
) -> Forecast:
    """Train and test one target on a feature frame."""
    options = options or ForecastOptions()
    options.validate()
    df, target = of_site(normalise_names(df), options.site_id), flat(target)
    declared = features or schemas.forecast_features(options.rolling_window_days)
    names, _ = select_features(df, declared)
    keys = options.partition_cols
    order = series_order(df, keys, order)
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    if rows_ahead is None and keys:
        lead = lead_by_interval if options.intervals == "exact" else lead_by_class
        labelled = lead(df, target, options.horizon_hours, (), keys, order)
    else:
        if rows_ahead is None:
            rows_ahead = horizon_rows(df, options.horizon_hours, keys, order[0])
        labelled = lead_target(df, target, rows_ahead, (), keys, order)
    labelled = stage(labelled, "labelled")
    complete = labelled.dropna(subset=names)
    split = chrono_split(complete, options.test_size, None, keys, order)
    split = split.select(*names, "label", "split").persist(LEVEL)
    try:
        samples = _counts(split)
        _require(sum(samples.values()), options.min_rows, "samples")
        assembler = VectorAssembler(
            inputCols=names, outputCol="features", handleInvalid="keep"
        )
        train = assembler.transform(split.where(F.col("split") == "train"))
        model = _regressor(options).fit(train)
        pipeline = PipelineModel([assembler, model])
        scored = pipeline.transform(split.where(F.col("split") == "test"))
        return Forecast(
            target=target,
            features=names,
            model=pipeline,
            metrics=_evaluate(scored, options),
            samples=samples,
            options=asdict(options) | {"order": order},
            importance=_sorted_importance(names, model),
            left_out=labelled.count() - sum(samples.values()),
        )
    finally:
        split.unpersist()


def of_site(df: DataFrame, site_id: str) -> DataFrame:
    """Rows of one site; of all if none is named."""
    return df.where(F.col("site_id") == site_id) if site_id else df


def run(
    spark: SparkSession,
    training_path: str,
    model_path: str,
    options: ForecastOptions | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    **kwargs,
) -> dict:
    """The training job: scan the stored training table, train both targets, store both models.

    The scan takes the site of the options and, if given, a range of time.  Models go
    to the folders `load` and `solar` of `model_path`; the result is that of `train_all`.
    """
    options = options or ForecastOptions()
    failed = dict.fromkeys(schemas.TARGETS)
    if not options.enabled:
        return {"status": "disabled", **failed}
    try:
        table = scan_training_data(
            spark, training_path, start, end, options.site_id, ordered=False
        )
    except (ValueError, OSError, PySparkException) as error:
        return {"status": "error", "error": str(error), **failed}
    result = train_all(table, options, **kwargs)
    if result["status"] == "success":
        for name in schemas.TARGETS:
            result[name].save(f"{model_path.rstrip('/')}/{name}")
    return result


def train_all(
    training_data: DataFrame, options: ForecastOptions | None = None, **kwargs
) -> dict:
    """Train every target; the result says how it went where data or options do not serve.

    Any other error is raised.
    """
    options = options or ForecastOptions()
    failed = dict.fromkeys(schemas.TARGETS)
    if not options.enabled:
        return {"status": "disabled", **failed}
    started = time.monotonic()
    train = (
        train_sequence_forecast
        if isinstance(options, SequenceOptions)
        else train_forecast
    )
    try:
        if training_data.isEmpty():
            return {"status": "no_data", **failed}
        df = normalise_names(training_data).persist(LEVEL)
        try:
            trained = {
                name: train(df, target, options, **kwargs)
                for name, target in schemas.TARGETS.items()
            }
        finally:
            df.unpersist()
    except (ValueError, OSError, PySparkException) as error:
        return {"status": "error", "error": str(error), **failed}
    return {
        "status": "success",
        **trained,
        "elapsed_seconds": time.monotonic() - started,
        "features_used": len(trained["load"].features),
    }


# --- sequences -------------------------------------------------------------


def _complete() -> Column:
    """Whether a run has no missing value."""
    return F.forall(F.flatten("x"), lambda v: v.isNotNull())


def _flattened(runs: DataFrame) -> DataFrame:
    """Runs as vectors, with zeros for missing values."""
    filled = F.transform(F.flatten("x"), lambda v: F.coalesce(v, F.lit(0.0)))
    return runs.withColumn("features", array_to_vector(filled)).drop("x")


def train_sequence_forecast(
    df: DataFrame,
    target: str,
    options: SequenceOptions | None = None,
    rows_ahead: int | None = None,
    features: Sequence[str] | None = None,
    order: Sequence[str] = ("time",),
) -> Forecast:
    """Train and test one target on runs of rows.

    The regressor sees a run as one long vector.  The linear one is fitted on blocks of rows (`runs`); for trees
    each run is stored whole.  Boosting stops when the loss
    on the validation rows has not fallen for `patience` rounds, and goes back to the best one.  The horizon is
    that of each series' own interval, unless `rows_ahead` gives it.
    """
    options = options or SequenceOptions()
    options.validate()
    df, target = of_site(normalise_names(df), options.site_id), flat(target)
    declared = features or schemas.forecast_features(options.rolling_window_days)
    names, _ = select_features(df, declared)
    keys = options.partition_cols
    order = series_order(df, keys, order)
    df = df.withColumn("_y", F.col(target).cast("double"))
    if rows_ahead is None and keys and options.intervals == "exact":
        # the value a run is to tell stands in its last row, as many rows ahead as the series needs
        facts = series_intervals(df, keys, order)
        df, widest, longest = with_row_counts(
            df, facts, keys, _ahead=row_horizon(options.horizon_hours)
        )
        df = lead_column(df, "_y", "_ahead", widest["_ahead"], "_later", keys, order, longest=longest)
        df = stage(df.drop("_y", "_ahead").withColumnRenamed("_later", "_y"), "ahead")
        _require(df.count(), options.sequence_length + 1, "records")
        rows_ahead = 0
    else:
        if rows_ahead is None:
            rows_ahead = horizon_rows(df, options.horizon_hours, keys, order[0])
        _require(df.count(), options.sequence_length + rows_ahead, "records")

    scaler = None
    if options.scale_features:
        basis = df
        if options.fit_scaler_on == "train":
            basis = chrono_split(df, options.test_size, None, keys, order).where(
                F.col("split") == "train"
            )
        scaler = Scaler.fit(basis, names)
        df = scaler.transform(df)

    if options.regressor == "linear":
        shape = Shape(options.sequence_length, rows_ahead, len(names), options.rows_between_runs)
        linear = LinearRuns.of(
            df, names, "_y", shape, keys, order, options.test_size, options.validation_split
        )
        samples, left_out = linear.counts()
        _require(sum(samples.values()), options.min_rows, "sequences")
        model = linear.fit(options.reg_param)
        return Forecast(
            target=target,
            features=names,
            model=PipelineModel([model]),
            metrics=_evaluate(linear.scored(model), options),
            samples=samples,
            options=asdict(options) | {"order": order},
            scaler=scaler,
            left_out=left_out,
        )
    runs = sequences(
        df,
        names,
        "_y",
        options.sequence_length,
        rows_ahead,
        keys,
        order,
        options.rows_between_runs,
    )
    spark = df.sparkSession
    runs_path, split_path = new_path(spark, "runs"), new_path(spark, "sequences")
    try:
        # a run is as many numbers as features times rows: on disk, once
        runs = stage(runs.withColumn("_whole", _complete()), "runs", runs_path)
        left_out = runs.where(~F.col("_whole")).count()
        split = chrono_split(
            runs.where("_whole"), options.test_size, options.validation_split, keys, order
        )
        stored = stage(
            split.select("x", F.col("y").alias("label"), "split"), "sequences", split_path
        )
        split = _flattened(stored)
        samples = _counts(split)
        _require(sum(samples.values()), options.min_rows, "sequences")
        fitting = split.where(F.col("split") != "test").withColumn(
            "validating", F.col("split") == "validation"
        )
        model, history = _fit_sequences(fitting, options)
        pipeline = PipelineModel([model])
        scored = pipeline.transform(split.where(F.col("split") == "test"))
        steps = [
            f"{name}@-{options.sequence_length - 1 - i}"
            for i in range(options.sequence_length)
            for name in names
        ]
        result = Forecast(
            target=target,
            features=names,
            model=pipeline,
            metrics=_evaluate(scored, options),
            samples=samples,
            options=asdict(options) | {"order": order},
            importance=_sorted_importance(steps, model),
            scaler=scaler,
            history=history,
            left_out=left_out,
        )
        if history:
            result.best_epoch = best_epoch(
                split.sparkSession.createDataFrame(
                    [(h["epoch"], h["train_loss"], h["validation_loss"]) for h in history],
                    "epoch int, train_loss double, validation_loss double",
                )
            ).first()["best_epoch"]
        return result
    finally:
        discard(spark, runs_path)
        discard(spark, split_path)


def early_stop(losses: Sequence[float], patience: int) -> tuple[int, int]:
    """Rounds that are run, and the best of them, where `patience` rounds without a lower loss end it.

    A loss that is no number (there are no rows to validate on) ends nothing, and all rounds are kept.
    """
    best, lowest = 0, float("inf")
    for i, loss in enumerate(losses, 1):
        if loss < lowest:
            best, lowest = i, loss
        elif best and i - best >= patience:
            return i, best
    return len(losses), best or len(losses)


def first_trees(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The boosted model as it was after `count` rounds."""
    context = SparkSession.active().sparkContext
    java, gateway = model._java_obj, context._gateway
    package = context._jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(package.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for i in range(count):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    return GBTRegressionModel(
        package.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    )


def _fit_sequences(fitting: DataFrame, options: SequenceOptions):
    """The model of the best boosting round, and the losses of the rounds that were run.

    Boosting is repeatable, so a longer run begins with the rounds of a shorter one: the number of rounds
    is doubled until the stop lies within it.
    """
    train = fitting.where(~F.col("validating"))
    held_out = fitting.where("validating")
    rounds = min(options.n_estimators, 2 * options.patience)
    while True:
        model = _regressor(options, maxIter=rounds).fit(train)
        held_losses = model.evaluateEachIteration(held_out, "squared")
        ran, best = early_stop(held_losses, options.patience)
        if ran < rounds or rounds == options.n_estimators:
            break
        rounds = min(options.n_estimators, 2 * rounds)
    losses = model.evaluateEachIteration(train, "squared")
    history = [
        {"epoch": i + 1, "train_loss": losses[i], "validation_loss": held_losses[i]}
        for i in range(ran)
    ]
    return first_trees(model, best), history
