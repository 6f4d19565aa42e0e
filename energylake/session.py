"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = 8, app: str = "energylake", staging: str | None = None
) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own.

    `staging` names the folder of staged tables where the settings name none.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if staging:
        builder = builder.config("spark.checkpoint.dir", staging)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables that every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Where that is
    unset, a folder in the warehouse, which all executors share too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder; `release` removes what was put there."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this process.

    To be called when the results that read them have been written: a frame is lazy, so
    the functions that return one cannot know when its staged inputs are done with.
    """
    while _made:
        discard(spark, _made.pop())


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later jobs scan the copy, with column pruning and push-down, instead of
    recomputing the plan; a lost executor costs no recomputation either.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(
        target, True
    )
