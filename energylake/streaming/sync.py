"""Streaming jobs: snapshots to readings, fan-out, periodic features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.reshape import points_to_readings, snapshot_points
from ..options import SyncOptions
from ..sources import generations, tables
from ..sources.snapshots import split_malformed, stream_snapshots, write_snapshots

VERSION = tables.VERSION


def _triggered(writer, options: SyncOptions, once: bool):
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{options.sync_interval_seconds} seconds")


def start_readings_sync(
    readings: DataFrame,
    path: str,
    checkpoint: str,
    options: SyncOptions | None = None,
    once: bool = True,
    status_path: str | None = None,
    arrival: str | None = None,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    quarantine_path: str | None = None,
    expand: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery | None:
    """Append a stream of readings; offsets advance only when a batch is written.

    Each micro-batch is appended with its number as version, so its cost does
    not depend on the size of the table, and a repeated batch adds rows that
    scans fold into one: at-least-once writes, exact reads.  Batches of a later checkpoint
    have higher versions, though their numbers start again.  Rows of one batch keep their order: that of the
    column `arrival`, where one is named, then that in which they were read.  `tables.compact`
    may rewrite months beside it.  With `status_path` every attempt leaves a row with the
    numbers of rows that were and were not written.  Where `split` is given, it turns a batch into its readings
    and the rows that cannot be read as such; the latter go to a folder of the batch at `quarantine_path`, which
    a repeated batch writes anew, and count as failed.  Where `expand` is given, rows are snapshots that it turns
    into readings (keeping version and order) after they have been spread to tasks.  Nothing is started where the
    options say so.
    """
    options = options or SyncOptions()
    options.validate()
    if not options.enabled:
        return None
    first = generations.epoch(readings.sparkSession, path, checkpoint) * tables.BATCHES
    order = F.struct(
        (F.col(arrival) if arrival else F.lit(None).cast("timestamp")).alias("arrived"),
        F.monotonically_increasing_id().alias("row"),
    )

    def report(batch: DataFrame, batch_id: int, ok: bool, done, failed, last) -> None:
        row = [(first + batch_id, ok, done, failed, last)]
        schema = (
            "batch_id long, ok boolean, records long, failed long, last_sync_time timestamp"
        )
        if status_path:
            spark = batch.sparkSession
            spark.createDataFrame(row, schema).write.mode("append").parquet(status_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        if split is None:
            write_rows(batch, batch_id, 0)
            return
        batch.persist()
        try:
            rows, bad = split(batch)
            place = f"{quarantine_path.rstrip('/')}/batch={first + batch_id}"
            seen = Observation()
            bad.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(place)
            write_rows(rows, batch_id, seen.get["n"])
        finally:
            batch.unpersist()

    def write_rows(batch: DataFrame, batch_id: int, malformed: int) -> None:
        if batch.isEmpty():
            report(batch, batch_id, True, 0, malformed, None)
            return
        seen = Observation()
        numbered = batch.withColumns(
            {VERSION: F.lit(first + batch_id).cast("long"), tables.ARRIVAL: order}
        )
        numbered = numbered.drop(arrival) if arrival else numbered

        def counted(rows: DataFrame) -> DataFrame:
            return rows.observe(
                seen,
                F.count(F.lit(1)).alias("records"),
                F.max("time").alias("last_sync_time"),
            )

        try:
            if expand:
                tables.append_expanded(numbered, path, "timestamp", lambda rows: counted(expand(rows)))
            else:
                tables.append(counted(numbered), path)
        except Exception:
            try:
                rows_lost = (expand(numbered) if expand else batch).count()
            except Exception:  # the rows themselves cannot be read: their number is unknown
                rows_lost = None
            report(batch, batch_id, False, 0, rows_lost, None)
            raise
        report(
            batch, batch_id, True, seen.get["records"], malformed, seen.get["last_sync_time"]
        )

    writer = readings.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint
    )
    return _triggered(writer, options, once).start()


def start_snapshot_sync(
    snapshots: DataFrame,
    path: str,
    checkpoint: str,
    options: SyncOptions | None = None,
    once: bool = True,
    status_path: str | None = None,
    quarantine_path: str | None = None,
) -> StreamingQuery | None:
    """Sync a stream of nested snapshots into the readings table.

    With `quarantine_path` the stream must keep malformed lines (see `stream_snapshots`); they are put there.
    """
    options = options or SyncOptions()

    def expand(rows: DataFrame) -> DataFrame:
        return points_to_readings(snapshot_points(rows), options.site_id, VERSION, tables.ARRIVAL)

    return start_readings_sync(
        snapshots, path, checkpoint, options, once, status_path,
        split=split_malformed if quarantine_path else None,
        quarantine_path=quarantine_path, expand=expand,
    )


def stream_in(spark: SparkSession, path: str, options: SyncOptions | None = None) -> DataFrame:
    """Snapshots of a folder as a stream, as many files at a time as the options say."""
    options = options or SyncOptions()
    return stream_snapshots(spark, path, options.max_files_per_trigger)


def pending_points(
    points: DataFrame,
    cursor: datetime | None = None,
    options: SyncOptions | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Points of a batch-mode sync: the first rows of each series from the cursor on.

    Without cursor the sync reaches back as far as the options say.
    """
    options = options or SyncOptions()
    return tables.points_since(
        points, cursor, options.batch_size, options.lookback_hours, tie_break=tie_break
    )


def synced_readings(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    site_id: str = "",
) -> DataFrame:
    """Readings as synced: the latest batch's value of every key of a range."""
    return tables.folded(
        tables.time_range(tables.table(spark, path), start, end, site_id)
    )


def sync_status(spark: SparkSession, status_path: str) -> DataFrame:
    """Totals of all batches; a batch that was repeated counts once.

    `failed` counts the rows of attempts that failed, as far as they could be read, and the malformed
    ones, `pending` those whose batch has not been written since.
    """
    attempts = spark.read.parquet(status_path)
    batches = attempts.groupBy("batch_id").agg(
        F.max("last_sync_time").alias("last_sync_time"),
        F.max("records").alias("records"),
        (
            F.coalesce(F.sum(F.when(~F.col("ok"), F.col("failed"))), F.lit(0))
            + F.coalesce(F.max(F.when(F.col("ok"), F.col("failed"))), F.lit(0))
        ).alias("failed"),
        F.max("ok").alias("written"),
        F.max("failed").alias("most"),
    )
    return batches.agg(
        F.max("last_sync_time").alias("last_sync_time"),
        F.max_by("records", F.when(F.col("written"), F.col("batch_id"))).alias("last_sync_count"),
        F.sum("records").alias("total_synced"),
        F.count_if("written").alias("batches"),
        F.count_if(~F.col("written")).alias("open_batches"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.sum(F.when(F.col("written"), 0).otherwise(F.coalesce("most", F.lit(0)))).alias(
            "pending"
        ),
    )


def drop_repeats(
    readings: DataFrame,
    delay: str = "1 hour",
    key: Sequence[str] = (*schemas.READING_KEY, "metric_value"),
) -> DataFrame:
    """Suppress repeats that arrive within `delay` of each other.

    A newer value of a reading is no repeat, and as the clock is that of arrival, no
    row is too late.  A value that comes back after another one within `delay` counts as a repeat
    here; `changes.changes_only` keeps it.  The sync does without: its scans fold repeats.
    """
    return (
        readings.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", delay)
        .dropDuplicatesWithinWatermark(list(key))
        .drop("_arrived")
    )


def start_fan_out(
    snapshots: DataFrame,
    checkpoint: str,
    points_path: str | None = None,
    json_path: str | None = None,
    callback: Callable[[DataFrame], None] | None = None,
    options: SyncOptions | None = None,
    once: bool = True,
    json_compression: str | None = None,
) -> StreamingQuery:
    """Send each batch of snapshots to several sinks, reading it once.

    A batch repeated after a failure is sent again: points carry its number, so
    that `stored_points` reads them once; files of JSON lines may hold repeats.
    """
    options = options or SyncOptions()
    spark = snapshots.sparkSession
    epoch = generations.epoch(spark, points_path, checkpoint) if points_path else 0

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if points_path:
                version = F.lit(epoch * tables.BATCHES + batch_id).cast("long")
                tables.write_points(
                    batch, points_path, "timestamp",
                    lambda rows: snapshot_points(rows).withColumn(VERSION, version),
                )
            if callback:
                callback(batch)
            if json_path:
                write_snapshots(batch, json_path, compression=json_compression)
        finally:
            batch.unpersist()

    writer = snapshots.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint
    )
    return _triggered(writer, options, once).start()


def stored_points(spark: SparkSession, path: str) -> DataFrame:
    """Points as stored: the latest batch's value of every point."""
    points = spark.read.parquet(path).drop("date")
    key = ["time", "measurement", "device_id", "field"]
    return tables.current(points, key, VERSION, near=["time", "device_id"]).drop(VERSION)


def start_periodic(
    source: DataFrame,
    job: Callable[[SparkSession], object],
    checkpoint: str,
    seconds: int = 3600,
    once: bool = False,
) -> StreamingQuery:
    """Run a batch job, such as the feature job, whenever new data has come in.

    At most once every `seconds`; the job's upsert makes a repetition harmless.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        job(batch.sparkSession)

    writer = source.writeStream.foreachBatch(run).option(
        "checkpointLocation", checkpoint
    )
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()
