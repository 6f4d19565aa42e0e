"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: the six white-space bytes that separate words
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def scan(
    rows: Column,
    begin: Column,
    advance: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    kind: str,
    width: int = 256,
) -> Column:
    """Array of `emit`(state, row) for each row, where `advance`(state, row) is the next state.

    `kind` is the type of what is emitted.  Rows are worked off in slices, so that appending copies a short
    array only: first the states at the slices' begins, then each slice.
    """

    def within(state: Column, rows: Column) -> Column:
        first = F.struct(state.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(s: Column, row: Column) -> Column:
            return F.struct(
                advance(s["at"], row).alias("at"),
                F.array_append(s["out"], emit(s["at"], row)).alias("out"),
            )

        return F.aggregate(rows, first, step, lambda s: s["out"])

    last = F.floor((F.size(rows) - 1) / width).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), last), lambda k: F.slice(rows, k * width + 1, F.lit(width))
    )

    def over(slices: Column) -> Column:
        begins = F.aggregate(
            slices,
            F.array(begin),
            lambda a, part: F.array_append(
                a, F.aggregate(part, F.element_at(a, -1), advance)
            ),
        )
        return let(
            begins, lambda b: F.flatten(F.transform(slices, lambda s, k: within(F.get(b, k), s)))
        )

    return F.when(F.size(rows) > 0, let(slices, over)).otherwise(
        F.array().cast(f"array<{kind}>")
    )


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(
    df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_task: int = 20_000
) -> DataFrame:
    """Gapless numbers from 0 within each key, in as many tasks as the rows need.

    `df` comes from a staged table, has a column `row_no` that differs in all rows, and
    no nulls in its keys.  A
    window over the key alone would put a hot key into one task.  So the rows
    of a key are dealt over buckets by hash, their numbers start where the counts
    of the buckets before end, and every window holds about `rows_per_task` rows.
    The number of buckets follows the key's count.
    """
    sizes = df.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / rows_per_task).cast("long").alias("_parts")
    )
    rows = df.join(sizes, keys).withColumn(
        "_part", F.pmod(F.xxhash64("row_no"), F.col("_parts"))
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        rows.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order, "row_no")
    return (
        rows.join(starts, [*keys, "_part"])
        .withColumn(out, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_parts", "_part", "_start")
    )


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b) if b else 0


def reach(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed on them.

    Its folder joins the workers' search path, as if it stood in PYTHONPATH.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    reach(df.sparkSession)
    return df.mapInArrow(run, schema)


#: keys that may be called hot at most; their facts are broadcast
MOST_HOT = 10_000
#: rows of one key that may meet in a task
ROWS_PER_KEY = 50_000


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` with the columns of `facts`, which has one row per `key` (null is a key too).

    Both come from staged tables.  `count` is the number of rows of each key, and is left out
    of the result.  A key with more than `ROWS_PER_KEY` rows and more than one in `MOST_HOT` of all rows
    is hot.  There are fewer than `MOST_HOT` of those whatever the size, so their facts
    are broadcast and their rows stay where they are; the other rows are shuffled to theirs.
    """
    facts = facts.withColumnRenamed(key, "_key")
    total = facts.agg(F.sum(count)).first()[0] or 0
    bound = max(ROWS_PER_KEY, ceil_div(total, MOST_HOT))
    is_hot = F.col(count) > bound
    hot, cold = facts.filter(is_hot).drop(count), facts.filter(~is_hot).drop(count)
    same = F.col(key).eqNullSafe(F.col("_key"))
    near = rows.join(F.broadcast(hot), same)
    far = rows.join(F.broadcast(hot.select("_key")), same, "left_anti").join(cold, same)
    return near.unionByName(far).drop("_key")
