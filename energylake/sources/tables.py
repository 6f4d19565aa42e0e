"""Month-partitioned tables: range scans, appends, upserts, retention.

Tables are parquet folders partitioned by `month_start`, the first day of the month
of `time`, and sorted by site and time inside their files, so that a range scan
prunes by folder and by row-group statistics.

Contents are replaced by files, in steps that readers see all at once (`generations`).  Rows that
others append meanwhile are in files of their own, so appends may go on beside a
compaction.  One job at a time replaces contents.

Rows of a streamed table carry a version, made of the epoch of the stream's checkpoint and the number of the
batch, and their place in the batch.  Of several rows of a key the one of the highest version
counts, of those the one that arrived last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    IntegerType,
    LongType,
    ShortType,
    TimestampNTZType,
    TimestampType,
)

from .. import schemas
from ..functions.temporal import month_start
from ..operators.reshape import (
    known_fields,
    latest_per_key,
    require_columns,
    training_features,
)
from ..operators.windows import first_n_per_series
from ..session import discard, new_path, stage
from . import generations
from .generations import table

MONTH = "month_start"
#: number of the batch that brought a row, above it the epoch of the checkpoint
VERSION = "ingest_batch"
#: place of a row among those of its batch
ARRIVAL = "ingest_order"
#: batches that one checkpoint may count
BATCHES = 1 << 40


# --- scans -----------------------------------------------------------------


def _bound(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def time_range(
    df: DataFrame,
    start: datetime | Column | None = None,
    end: datetime | Column | None = None,
    site_id: str = "",
) -> DataFrame:
    """Rows of a time range, both ends included, optionally of one site.

    The range is repeated on the partition column, because Spark does not
    derive one from the other.
    """
    partitioned = MONTH in df.columns
    if start is not None:
        df = df.where(F.col("time") >= _bound(start))
        if partitioned:
            df = df.where(F.col(MONTH) >= month_start(_bound(start)))
    if end is not None:
        df = df.where(F.col("time") <= _bound(end))
        if partitioned:
            df = df.where(F.col(MONTH) <= month_start(_bound(end)))
    if site_id:
        df = df.where(F.col("site_id") == site_id)
    return df


def version_rank(columns: Sequence[str], key: Sequence[str], version: str) -> Column:
    """Order of the rows of a key: version (null lowest), arrival, then the other values.

    Scans, compaction and upserts all use it, so a row that wins in one wins in the others.
    """
    arrival = [F.col(ARRIVAL)] if ARRIVAL in columns else []
    others = [c for c in columns if c not in {*key, version, ARRIVAL, MONTH, "date"}]
    return F.struct(
        F.col(version).isNotNull(), F.col(version), *arrival, *[F.col(f"`{c}`") for c in others]
    )


def folded(rows: DataFrame) -> DataFrame:
    """Readings with the value of the highest version of each key.

    Tables without versions are returned as they are.  Repeats within a version
    are settled by arrival, or by the greatest value where that was not noted.
    """
    if VERSION not in rows.columns:
        return rows.drop(MONTH)
    rows = rows.select(
        *[c for c in (*schemas.READING_KEY, "metric_value", VERSION, ARRIVAL) if c in rows.columns]
    )
    # versions of a key are few; all metrics of a moment move together, and stay so for wide rows
    rows = rows.repartition(*[k for k in schemas.READING_KEY if k != "metric_name"])
    return rows.groupBy(*schemas.READING_KEY).agg(
        F.max_by("metric_value", version_rank(rows.columns, schemas.READING_KEY, VERSION)).alias(
            "metric_value"
        )
    )


def scan_readings(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    site_id: str = "",
    lookback_days: int = 30,
    fold: bool = True,
) -> DataFrame:
    """Readings of a range: by default the last `lookback_days` up to now.

    Versions are folded after the range has been cut out, so a scan costs what its months hold.
    Without `fold` all versions are returned, for callers that leave out some series first.
    """
    end = end or datetime.now().astimezone()
    start = start or end - timedelta(days=lookback_days)
    rows = time_range(table(spark, path), start, end, site_id)
    return folded(rows) if fold else rows


def scan_training_data(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    site_id: str = "",
    limit: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Training rows in time order; `limit` keeps the oldest rows only.

    Training itself needs no order: `ordered=False` saves the sort.
    """
    rows = time_range(table(spark, path), start, end, site_id).drop(MONTH)
    if ordered or limit is not None:
        rows = rows.orderBy("time", "site_id", "device_id")
    return rows if limit is None else rows.limit(limit)


def register_training_view(
    spark: SparkSession, path: str, name: str = "training_features"
) -> None:
    """Temporary view of the training table under column-safe names."""
    training_features(table(spark, path).drop(MONTH)).createOrReplaceTempView(name)


def points_since(
    points: DataFrame,
    cursor: datetime | Column | None = None,
    limit: int | None = None,
    lookback_hours: int = 24,
    now: datetime | Column | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Known points at or after the cursor, optionally the first n per series."""
    if cursor is None:
        now = F.current_timestamp() if now is None else _bound(now)
        cursor = now - F.expr(f"INTERVAL {int(lookback_hours)} HOURS")
    rows = points.where((F.col("time") >= _bound(cursor)) & known_fields())
    if limit is None:
        return rows
    series = ["measurement", "device_id", "field"]
    return first_n_per_series(rows, series, ["time", *tie_break], limit)


#: widths of the ranges by which a page is looked for
PAGE_RANGES = (1 << 44, 1 << 32, 1 << 20, 1 << 8, 1)
#: rows that are few enough to be sorted for a page
PAGE_ROWS = 100_000


def page(
    df: DataFrame,
    order: Sequence[str],
    number: int,
    rows: int = 1000,
    most_sorted: int = PAGE_ROWS,
) -> DataFrame:
    """One page of the ordered rows, counted from 0.

    Where the first column of `order` is a time or a whole number, its values are counted by ranges, ever
    narrower ones within those that hold the page, until `most_sorted` rows are left; only these are sorted.  So a deep
    page costs some counts, and no task holds the rows before it.  Other columns are sorted as a whole.
    """
    kind = df.schema[order[0]].dataType
    column = F.col(order[0])
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        key = F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, (LongType, IntegerType, ShortType, ByteType)):
        key = column.cast("long")
    else:
        return df.orderBy(*order).offset(number * rows).limit(rows)
    offset = number * rows
    near = df
    for width in PAGE_RANGES:
        ranges = near.groupBy(F.floor(key / F.lit(width)).cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n"))
        # a null comes first, as in the order of the rows
        found = sorted(((r["r"], r["n"]) for r in ranges.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        before, inside = 0, []
        for place, n in found:
            if before + n > offset and before < offset + rows:
                inside.append((place, n, before))
            before += n
        if not inside:
            return df.where("false")
        offset -= inside[0][2]
        low, high = inside[0][0], inside[-1][0]
        if high is None:
            near = near.where(column.isNull())
            break
        within = key < (high + 1) * width
        if low is not None:
            near = near.where(key >= low * width).where(within)
        else:
            near = near.where(column.isNull() | within)
        if sum(n for _, n, _ in inside) <= max(most_sorted, rows):
            break
    return near.orderBy(*order).offset(offset).limit(rows)


def next_page(
    df: DataFrame, order: Sequence[str], after: Sequence | None = None, rows: int = 1000
) -> DataFrame:
    """The first `rows` rows beyond the values `after` of the columns `order`.

    However far the page lies behind, only its own rows are sorted together.  `order`
    must tell rows apart.
    """
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            beyond |= equal & (F.col(name) > F.lit(value))
            equal &= F.col(name) == F.lit(value)
        df = df.where((F.col(order[0]) >= F.lit(after[0])) & beyond)
    return df.orderBy(*order).limit(rows)


def table_stats(df: DataFrame) -> DataFrame:
    """Row count and time range in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("time").alias("earliest_time"),
        F.max("time").alias("latest_time"),
    )


# --- sinks -----------------------------------------------------------------


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, month_start(F.col("time")))


def _laid_out(df: DataFrame) -> DataFrame:
    """Rows spread evenly by month: large months are split over several tasks."""
    order = [c for c in (MONTH, "site_id", "time") if c in df.columns]
    return df.hint("rebalance", MONTH).sortWithinPartitions(*order)


def append(df: DataFrame, path: str, dealt: bool = False) -> None:
    """Append rows; those `dealt` to tasks of bounded size already are sorted there, and move no more."""
    rows = with_month(df)
    if dealt:
        order = [c for c in (MONTH, "site_id", "time") if c in rows.columns]
        rows = rows.sortWithinPartitions(*order)
    else:
        rows = _laid_out(rows)
    rows.write.mode("append").partitionBy(MONTH).parquet(path)


#: size of what a task gets whose rows become many
EXPANDED_BYTES = "8m"


def _expanded(
    df: DataFrame, time_col: str, expand: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Rows spread by day before each becomes many, so that the shuffle moves few.

    For streams: their session is their own, so that the size of its tasks may be set.
    """
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    df.sparkSession.conf.set(size, EXPANDED_BYTES)
    dated = df.withColumn("_day", F.to_date(time_col))
    return expand(dated.hint("rebalance", "_day").drop("_day"))


def append_expanded(
    df: DataFrame, path: str, time_col: str, expand: Callable[[DataFrame], DataFrame],
) -> None:
    """Append the many rows that `expand` makes of each row of a batch of a stream.

    `time_col` is the time of all rows that come of a row.
    """
    rows = with_month(_expanded(df, time_col, expand))
    # the readings of a moment stand together, and so they do in the shuffles of those who read them
    order = [c for c in (MONTH, "site_id", "time", "device_id") if c in rows.columns]
    rows.sortWithinPartitions(*order).write.mode("append").partitionBy(MONTH).parquet(path)


def write_points(
    points: DataFrame,
    path: str,
    time_col: str = "time",
    expand: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Append telemetry points, partitioned by measurement and day.

    With `expand` the points that it makes of rows with `time_col`, of a batch of a stream.
    """
    if expand:
        dated = _expanded(points, time_col, expand).withColumn("date", F.to_date("time"))
    else:
        dated = points.withColumn("date", F.to_date("time")).hint("rebalance", "measurement", "date")
    (
        dated
        .sortWithinPartitions("measurement", "date", "device_id", "time")
        .write.mode("append")
        .partitionBy("measurement", "date")
        .parquet(path)
    )


def current(
    versions: DataFrame, key: Sequence[str], version: str, near: Sequence[str] = ()
) -> DataFrame:
    """Latest version of each key of an append-only table; `near`: see `latest_per_key`."""
    return latest_per_key(
        versions.drop(MONTH), key, version_rank(versions.columns, key, version), near
    )


_pending = generations.pending
finish_pending = generations.finish


def _data_files(spark: SparkSession, path: str, months: Sequence[date] | None = None) -> list[str]:
    """The table's files, of some months or of all."""
    hidden = generations.state(spark, path).hidden
    files = [
        f for f in spark.read.parquet(path).inputFiles() if generations.place(f) not in hidden
    ]
    if months is None:
        return sorted(files)
    wanted = {f"/{MONTH}={m.isoformat()}/" for m in months}
    return sorted(f for f in files if any(w in f for w in wanted))


def _replace(df: DataFrame, path: str, old: Sequence[str], keep_old: bool = False) -> None:
    """Put the rows of `df` in place of the files `old`; `df` may read those."""
    spark = df.sparkSession
    staged = _pending(path)
    if generations.exists(spark, staged):
        raise RuntimeError(f"{staged}: another replacement is not finished")
    _laid_out(df).write.partitionBy(MONTH).parquet(f"{staged}/data")
    _commit(spark, staged, old, keep_old)
    finish_pending(spark, path)


def _commit(spark: SparkSession, staged: str, old: Sequence[str], keep_old: bool = False) -> None:
    generations.commit(spark, staged.removesuffix("_pending"), old, keep_old)


def upsert(
    df: DataFrame,
    path: str,
    key: Sequence[str],
    version: str | None = None,
    keep_old: bool = False,
) -> None:
    """Insert rows or replace those of the same key; only touched months move.

    Of several new rows of a key the one of the highest `version` is kept (see `version_rank`); without
    `version` the one whose other columns are greatest, so the result does not
    depend on the order of the rows.  `df` is worked out once, and each touched
    month is written once.  With `keep_old` the files that were replaced stay for jobs that still read
    them, until `vacuum`; the table must be read by `table` and the scans then, which pass over them.
    """
    spark = df.sparkSession
    require_columns(df, ["time", *key])
    finish_pending(spark, path)
    payload = [c for c in df.columns if c not in key]
    rank = (
        version_rank(df.columns, key, version)
        if version
        else F.struct(*[F.col(f"`{c}`") for c in payload])
    )
    place = new_path(spark, "upsert")
    try:
        new = stage(with_month(df), "upsert", f"{place}/rows")
        # only the keys move to find out whether any comes twice
        copies = new.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count(F.lit(1)).alias("_n"))
        if not copies.where("_n > 1").isEmpty():
            new = stage(latest_per_key(new, key, rank), "upsert", f"{place}/latest")
        # one value per month of the covered time span
        months = [r[0] for r in new.select(MONTH).distinct().collect()]
        here = generations.exists(spark, path)
        if not months and here:
            return
        old = _data_files(spark, path, months) if here else []
        rows = new
        if old:
            # The old rows need no shuffle where the new keys are few enough to be
            # broadcast, which Spark decides by their size.
            keys = new.select(*[F.col(f"`{k}`") for k in key])
            kept = generations.read_files(spark, path, old).join(keys, list(key), "left_anti")
            rows = kept.unionByName(new, allowMissingColumns=True)
        _replace(rows, path, old, keep_old)
    finally:
        discard(spark, place)


def compact(
    spark: SparkSession,
    path: str,
    key: Sequence[str],
    version: str,
    months: Sequence[date] | None = None,
    keep_old: bool = False,
) -> None:
    """Rewrite months of an append-only table with the latest versions only.

    Rows appended while this runs stay as they are.  Readers that fold versions see the
    same rows at every moment.  `keep_old`: see `upsert`.
    """
    finish_pending(spark, path)
    old = _data_files(spark, path, months)
    if old:
        rows = generations.read_files(spark, path, old)
        rank = version_rank(rows.columns, key, version)
        _replace(latest_per_key(rows, [*key, MONTH], rank), path, old, keep_old)


def vacuum(spark: SparkSession, path: str, before: datetime) -> int:
    """Delete the files that replacements have kept and that were retired before a time."""
    return generations.vacuum(spark, path, before)


def not_expired(
    df: DataFrame, now: datetime | Column, days: int = 7, time_col: str = "time"
) -> DataFrame:
    """Rows of the last `days` days before `now`."""
    limit = _bound(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(time_col) >= limit)


def expire(spark: SparkSession, path: str, now: datetime, days: int = 7) -> None:
    """Remove rows older than `days`: old months whole, the border month by rows."""
    finish_pending(spark, path)
    limit = now - timedelta(days=days)
    border = date(limit.year, limit.month, 1)
    months = [
        r[0]
        for r in table(spark, path).select(MONTH).where(F.col(MONTH) <= border).distinct().collect()
    ]
    if border in months:
        old = _data_files(spark, path, [border])
        kept = not_expired(generations.read_files(spark, path, old), now, days)
        _replace(kept, path, old)
    for month in months:
        if month < border:
            discard(spark, f"{path.rstrip('/')}/{MONTH}={month.isoformat()}")
