"""JSON-lines snapshots: batch and stream source, sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.reshape import rounded_snapshot, with_net_grid_flow
from ..schemas import SNAPSHOT


#: column of the text of lines that are no snapshots
MALFORMED = "_malformed"
WITH_MALFORMED = StructType([*SNAPSHOT.fields, StructField(MALFORMED, StringType())])


def read_snapshots(spark: SparkSession, path: str, keep_malformed: bool = False) -> DataFrame:
    """Snapshots of a file or folder; the net flow is worked out anew.

    A line that cannot be read as a snapshot has null fields; with `keep_malformed` its text is
    in a column of its own, see `split_malformed`.
    """
    reader = spark.read.option("columnNameOfCorruptRecord", MALFORMED)
    return with_net_grid_flow(
        reader.schema(WITH_MALFORMED if keep_malformed else SNAPSHOT).json(path)
    )


def stream_snapshots(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int = 1000,
    keep_malformed: bool = False,
) -> DataFrame:
    """Snapshots of a folder as a stream; late files are picked up too."""
    stream = (
        spark.readStream.schema(WITH_MALFORMED if keep_malformed else SNAPSHOT)
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(path)
    )
    return with_net_grid_flow(stream)


def split_malformed(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots, and the text of the lines that are none.

    A line is no snapshot if it is no JSON, if a field has another type, or if it has no time.  `snapshots`
    has the column that `keep_malformed` gives, and must be held (`persist`), as both parts read it.
    """
    bad = F.col(MALFORMED).isNotNull() | F.col("timestamp").isNull()
    text = F.coalesce(MALFORMED, F.to_json(F.struct(*[f.name for f in SNAPSHOT.fields])))
    return snapshots.where(~bad).drop(MALFORMED), snapshots.where(bad).select(text.alias("line"))


def snapshot_json(snapshots: DataFrame) -> DataFrame:
    """One JSON text per snapshot, rounded, with ISO timestamps."""
    rounded = rounded_snapshot(snapshots)
    fields = [
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")
        if f.name == "timestamp"
        else F.col(f.name)
        for f in SNAPSHOT.fields
    ]
    return rounded.select(F.to_json(F.struct(*fields)).alias("value"))


def write_snapshots(
    snapshots: DataFrame, path: str, mode: str = "append", compression: str | None = None
) -> None:
    snapshot_json(snapshots).write.mode(mode).text(path, compression=compression)
