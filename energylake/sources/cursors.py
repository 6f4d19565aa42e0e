"""Batch reading of points with a cursor for every series.

One cursor for all series cannot go with a limit per series: it moves with the fastest one, and the rows
that the limit has cut off the others are skipped.  So every series has a mark of its own, the place
of its last row that was read.  The marks are a table; the least of them bounds the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reshape import known_fields
from ..operators.series import match_keys
from ..session import discard, new_path, stage
from . import generations

POINT_SERIES = ("measurement", "device_id", "field")
MARK = "mark"


def _place(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def stored_marks(spark: SparkSession, path: str) -> DataFrame | None:
    """The marks of the last complete round; None before the first."""
    rounds = [
        n for n in names(spark, path) if generations.exists(spark, f"{path}/{n}/_SUCCESS")
    ]
    return spark.read.parquet(f"{path}/{max(rounds)}") if rounds else None


def names(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in generations.names_in(spark, path) if n.isdigit())


def unread(
    points: DataFrame,
    marks: DataFrame | None,
    start: datetime | Column,
    limit: int,
    order: Sequence[str] = ("time",),
    keys: Sequence[str] = POINT_SERIES,
) -> DataFrame:
    """The first `limit` rows of every series beyond its mark.

    A series without mark begins at `start`.  Rows that tie with the last one in `order` are read along with
    it, so that the next round can begin right after.  Null keys are a series like any other.
    """
    begin = start if isinstance(start, Column) else F.lit(start)
    new = F.col(order[0]) >= begin
    if marks is not None:
        # series that have no mark yet begin at `start`, so the scan reaches back to whichever is earlier
        least = marks.agg(F.min(f"{MARK}.{order[0]}")).first()[0]
        if least is not None:
            points = points.where(F.col(order[0]) >= F.least(begin, F.lit(least)))
        points = match_keys(points, marks.select(*keys, MARK), keys, "left")
        new = F.when(F.col(MARK).isNull(), new).otherwise(_place(order) > F.col(MARK))
    rows = points.where(new).drop(MARK)
    line = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.rank().over(line)).where(F.col("_rank") <= limit).drop("_rank")


def advanced(
    marks: DataFrame | None,
    read: DataFrame,
    order: Sequence[str] = ("time",),
    keys: Sequence[str] = POINT_SERIES,
) -> DataFrame:
    """The marks after `read`; series without new rows keep theirs."""
    last = read.groupBy(*keys).agg(F.max(_place(order)).alias(MARK))
    if marks is None:
        return last
    return marks.select(*keys, MARK).unionByName(last).groupBy(*keys).agg(F.max(MARK).alias(MARK))


def read_round(
    points: DataFrame,
    marks_path: str,
    write: Callable[[DataFrame], None],
    start: datetime | Column,
    limit: int = 100,
    order: Sequence[str] = ("time",),
    keys: Sequence[str] = POINT_SERIES,
) -> int:
    """One round: `write` gets the unread rows, then the marks move.  The number of rows.

    A round that dies after writing is read again, so `write` should bear repeated rows, as the
    versioned tables and upserts do.  Rows that arrive behind their series' mark are not read; a
    stream, whose offsets go by arrival, reads those.
    """
    spark = points.sparkSession
    marks_path = marks_path.rstrip("/")
    place = new_path(spark, "round")
    try:
        marks = stored_marks(spark, marks_path)
        rows = stage(
            unread(points.where(known_fields()), marks, start, limit, order, keys), "round", place
        )
        count = rows.count()
        if count:
            write(rows)
            known = names(spark, marks_path)
            number = max(known, default=0) + 1
            advanced(marks, rows, order, keys).write.mode("overwrite").parquet(f"{marks_path}/{number}")
            # the round before stays for readers that have just listed it
            for old in known[:-1]:
                discard(spark, f"{marks_path}/{old}")
        return count
    finally:
        discard(spark, place)
