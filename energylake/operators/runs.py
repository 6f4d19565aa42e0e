"""Linear forecasts from runs of rows, without storing each row once per run.

Rows are kept in blocks that overlap by one run, so a row is stored about twice however long the runs
are.  A run is a block and an offset in it.  A least-squares fit needs only the sums of products of the
runs' values; each task adds up those of its blocks, and the tasks' sums are added in steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .series import MAX_ROWS, match_keys, with_positions

#: rows that begin a run in a block, at least
BLOCK_ROWS = 256
#: tasks that add up the sums of other tasks
ADDERS = 16


@dataclass(frozen=True)
class Shape:
    """Runs of `length` rows of `width` values, with the target `ahead` rows after their end."""

    length: int
    ahead: int
    width: int
    stride: int = 1

    @property
    def block(self) -> int:
        return max(BLOCK_ROWS, self.length)

    @property
    def reach(self) -> int:
        return self.length - 1 + self.ahead


def stored_blocks(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    shape: Shape,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """(`keys`, block, x, y): the values and targets of a block's rows and of those its runs reach into.

    Missing values are NaN.  Series shorter than a run have no block.
    """
    missing = float("nan")
    rows = with_positions(df.select(*dict.fromkeys([*keys, *order, *features, target])), keys, order, "_p", "_n", max_rows)
    width, reach = shape.block, shape.reach
    first = F.greatest(F.lit(0), F.floor((F.col("_p") - (width + reach)) / width) + 1)
    last = F.least(F.floor(F.col("_p") / width), F.floor((F.col("_n") - 1 - reach) / width))
    rows = rows.where((F.col("_n") > reach) & (first <= last))
    value = [F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in features]
    item = F.struct(
        F.col("_p").alias("p"), F.array(*value).alias("x"),
        F.coalesce(F.col(target).cast("double"), F.lit(missing)).alias("y"),
    )
    blocks = (
        rows.select(*keys, F.explode(F.sequence(first, last)).alias("block"), item.alias("item"))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    return blocks.select(
        *keys,
        "block",
        F.flatten(F.transform("items", lambda i: i["x"])).alias("x"),
        F.transform("items", lambda i: i["y"]).alias("y"),
    )


def _cutter(shape: Shape) -> Callable:
    """Function of (block, x, y) that gives runs as rows of a matrix, their targets, and which are whole.

    Made here so that workers need not find this package.
    """
    length, reach, width, stride, most = shape.length, shape.reach, shape.width, shape.stride, shape.block

    def runs(block: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = x.reshape(-1, width)
        count = min(most, len(rows) - reach)
        views = np.lib.stride_tricks.sliding_window_view(rows, length, axis=0)[:count]
        labels = y[reach : reach + count]
        kept = ~np.isnan(labels) & ((block * most + np.arange(count)) % stride == 0)
        matrix = views[kept].transpose(0, 2, 1).reshape(-1, length * width)
        return matrix, labels[kept], ~np.isnan(matrix).any(axis=1)

    return runs


def _placed(blocks: DataFrame, shape: Shape, keys: Sequence[str]) -> DataFrame:
    """`blocks` with the number of whole runs in them (`runs`, `left_out` others), before them in their series, and in all of it."""
    runs = _cutter(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [
                runs(b.as_py(), x.values.to_numpy(), y.values.to_numpy())[2]
                for b, x, y in zip(batch.column("block"), batch.column("x"), batch.column("y"), strict=True)
            ]
            others = [batch.column(c) for c in names]
            counts = [pa.array([int(w.sum()) for w in whole], pa.int64()), pa.array([int((~w).sum()) for w in whole], pa.int64())]
            yield pa.RecordBatch.from_arrays([*others, *counts], [*names, "runs", "left_out"])

    names = [*keys, "block"]
    schema = blocks.select(*names).schema.add("runs", "long").add("left_out", "long")
    counts = stage(blocks.mapInArrow(run, schema), "run-counts")
    series = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = series.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("runs").over(earlier), F.lit(0))).withColumn(
        "total", F.sum("runs").over(series)
    )
    return match_keys(blocks, counts, names, "inner")


@dataclass
class LinearRuns:
    """Blocks of runs with the shares of their split, and the fit on the training runs."""

    blocks: DataFrame
    shape: Shape
    test_size: float
    validation_split: float

    @classmethod
    def of(
        cls,
        df: DataFrame,
        features: Sequence[str],
        target: str,
        shape: Shape,
        keys: Sequence[str],
        order: Sequence[str],
        test_size: float,
        validation_split: float,
        max_rows: int = MAX_ROWS,
    ) -> LinearRuns:
        blocks = stage(stored_blocks(df, features, target, shape, keys, order, max_rows), "run-blocks")
        placed = _placed(blocks, shape, keys)
        return cls(placed.select("block", "x", "y", "runs", "left_out", "before", "total"), shape, test_size, validation_split)

    def _each(self) -> Callable:
        """Function of a batch that gives (matrix, labels, part) for each block; parts are 0 train, 1 validation, 2 test."""
        runs, test, validation = _cutter(self.shape), self.test_size, self.validation_split

        def each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            columns = [batch.column(c) for c in ("block", "x", "y", "before", "total")]
            for b, x, y, before, total in zip(*columns, strict=True):
                matrix, labels, whole = runs(b.as_py(), x.values.to_numpy(), y.values.to_numpy())
                fitting = np.floor(total.as_py() * (1 - test))
                place = before.as_py() + np.arange(whole.sum())
                part = (place >= np.floor(fitting * (1 - validation))).astype(int) + (place >= fitting)
                yield matrix[whole], labels[whole], part

        return each

    def counts(self) -> tuple[dict[str, int], int]:
        """Whole runs by split, and the runs that lack a value."""
        whole = self.blocks.where("runs > 0 OR left_out > 0")
        fitting = F.floor(F.col("total") * F.lit(1 - self.test_size))
        training = F.floor(fitting * F.lit(1 - self.validation_split))
        end = F.col("before") + F.col("runs")

        def upto(bound):
            return F.greatest(F.lit(0), F.least(end, bound) - F.col("before"))

        facts = whole.agg(
            F.sum(upto(training)), F.sum(upto(fitting)), F.sum("runs"), F.sum("left_out")
        ).first()
        train, fit, all_runs, left_out = (int(v or 0) for v in facts)
        counts = {"train": train, "validation": fit - train, "test": all_runs - fit}
        return {k: v for k, v in counts.items() if v}, left_out

    def fit(self, reg_param: float = 0.0) -> LinearRegressionModel:
        """Least squares on the training runs; `reg_param` weighs squared coefficients of standardised values.

        A task holds the sums of products of all values of a run: their number squared.
        """
        each = self._each()
        size = self.shape.length * self.shape.width

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # values are taken less those of the task's first run, which keeps the sums small
            total, shift = None, None
            for batch in batches:
                for matrix, labels, part in each(batch):
                    rows = np.column_stack([matrix, labels])[part == 0]
                    if len(rows):
                        if total is None:
                            shift, total = rows[0].copy(), np.zeros((size + 2, size + 2))
                        z = np.column_stack([rows - shift, np.ones(len(rows))])
                        total += z.T @ z
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([shift], pa.list_(pa.float64()))],
                    ["total", "shift"],
                )

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, shift = None, None
            for batch in batches:
                for t, s in zip(batch.column("total"), batch.column("shift"), strict=True):
                    t = t.values.to_numpy().reshape(size + 2, size + 2).copy()
                    s = s.values.to_numpy()
                    if total is None:
                        total, shift = t, s
                        continue
                    # the other task's values, less this one's shift
                    move = s - shift
                    n, sums = t[-1, -1], t[-1, :-1].copy()
                    t[:-1, :-1] += np.outer(move, sums) + np.outer(sums, move) + n * np.outer(move, move)
                    t[-1, :-1] += n * move
                    t[:-1, -1] = t[-1, :-1]
                    total += t
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([shift], pa.list_(pa.float64()))],
                    ["total", "shift"],
                )

        schema = "total array<double>, shift array<double>"
        sums = self.blocks.mapInArrow(products, schema).repartition(ADDERS).mapInArrow(added, schema)
        (one,) = list(added(iter(sums.toArrow().to_batches()))) or (None,)
        if one is None:
            raise ValueError("no whole run to train on")
        total = one.column("total")[0].values.to_numpy().reshape(size + 2, size + 2)
        shift = one.column("shift")[0].values.to_numpy()
        return _solved(total, shift, reg_param)

    def scored(self, model: LinearRegressionModel, part: int = 2) -> DataFrame:
        """(label, prediction) of the runs of one part of the split."""
        each = self._each()
        weights, intercept = model.coefficients.toArray(), model.intercept

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for matrix, labels, own in each(batch):
                    some = own == part
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(labels[some]), pa.array(matrix[some] @ weights + intercept)],
                        ["label", "prediction"],
                    )

        return self.blocks.mapInArrow(run, "label double, prediction double")


def _solved(total: np.ndarray, shift: np.ndarray, reg_param: float) -> LinearRegressionModel:
    """The fit from sums of products of (values, target, 1), all but the last less `shift`."""
    n, sums = total[-1, -1], total[-1, :-1]
    mean = sums / n
    spread = total[:-1, :-1] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(spread), 0))
    used = np.flatnonzero(std[:-1] > 1e-12 * np.maximum(1, np.abs(shift[:-1])))
    weights = np.zeros(len(std) - 1)
    if std[-1] > 0 and len(used):
        scale = std[used]
        a = spread[np.ix_(used, used)] / np.outer(scale, scale)
        b = spread[used, -1] / (scale * std[-1])
        a[np.diag_indices(len(used))] += reg_param / std[-1]
        weights[used] = np.linalg.lstsq(a, b, rcond=1e-12)[0] * std[-1] / scale
    centre = mean + shift
    intercept = centre[-1] - weights @ centre[:-1]
    return _as_model(weights, float(intercept))


def _as_model(weights: np.ndarray, intercept: float) -> LinearRegressionModel:
    """A fitted model as Spark's own, which saves, loads and predicts."""
    from pyspark.sql import SparkSession

    context = SparkSession.active().sparkContext
    package = context._jvm.org.apache.spark.ml.regression
    coefficients = _py2java(context, Vectors.dense(weights))
    return LinearRegressionModel(package.LinearRegressionModel("linearRuns", coefficients, intercept))
