"""Streams reduced to the rows at which a value differs from the last one.

The last value of every key is kept as state of the stream, so a value that comes back after
another one is a change again, in whichever batch that happens.  Nothing waits for a watermark.

Keys that are kept for ever share their state by buckets, whose rows are compared column by column: a key costs
no call of its own.  Keys with a time limit have a state each, as each has its own clock.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import (
    ArrayType,
    IntegralType,
    MapType,
    StructType,
    TimestampType,
    VariantType,
)

from .. import schemas

#: groups to which keys are dealt by hash; a checkpoint belongs to one number
BUCKETS = 512
#: types that are no plain values, whose keys are not compared as columns
NESTED = (ArrayType, MapType, StructType, VariantType)


def _step(columns: Sequence[str], value: str, order: Sequence[str], keep_ms: int | None) -> Callable:
    """Rows of a key whose value differs from that of the row before, and the new last value.

    The function is made here so that workers need not find this package.
    """
    columns, order = list(columns), list(order)

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # the rows of one key in one batch; arrow may hand them over in several pieces
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(order, kind="stable", na_position="first", ignore_index=True)
        values = batch[value]
        before = values.shift(1)
        same = (values == before) | (values.isna() & before.isna())
        same.iloc[0] = False
        if state.exists:
            (last,) = state.get
            first = values.iloc[0]
            same.iloc[0] = last is None if pd.isna(first) else last == first
        newest = values.iloc[-1]
        state.update((None if pd.isna(newest) else newest.item() if hasattr(newest, "item") else newest,))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield batch.loc[~same, columns]

    return step


def _bucket_step(columns: Sequence[str], keys: Sequence[str], value: Sequence[str], order: Sequence[str]) -> Callable:
    """Changed rows of all keys of a bucket; its state is the last value of each, as one table.

    `value` is one or several columns, of which any may differ.  The function is made here so that workers
    need not find this package.
    """
    columns, keys, value, order = list(columns), list(keys), list(value), list(order)
    key_names = [f"k{i}" for i in range(len(keys))]
    value_names = [f"v{i}" for i in range(len(value))]

    def step(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the rows of one bucket in one batch; arrow may hand them over in several pieces
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(order, kind="stable", na_position="first", ignore_index=True)
        lines = batch[[*keys, *value]].set_axis([*key_names, *value_names], axis=1)
        known = 0
        if state.exists:
            # the last values stand before the rows of the batch
            stored = pa.ipc.open_stream(state.get[0]).read_pandas()
            known = len(stored)
            lines = pd.concat([stored, lines], ignore_index=True)
        number = lines.groupby(key_names, sort=False, dropna=False).ngroup()
        same = number.duplicated()
        for name in value_names:
            before = lines[name].groupby(number).shift(1)
            same &= (lines[name] == before) | (lines[name].isna() & before.isna())
        newest = pa.Table.from_pandas(lines[~number.duplicated(keep="last")], preserve_index=False)
        sink = pa.BufferOutputStream()
        packed = pa.ipc.IpcWriteOptions(compression="lz4")
        with pa.ipc.new_stream(sink, newest.schema, options=packed) as out:
            out.write_table(newest)
        state.update((sink.getvalue().to_pybytes(),))
        yield batch.loc[~same.to_numpy()[known:], columns]

    return step


def _by_buckets(readings: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """`changes_only` with a state for each bucket of keys."""
    kinds = {f.name: f.dataType for f in readings.schema.fields}

    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    # pandas would turn whole numbers beside a null into doubles
    whole = [c for c in kinds if isinstance(kinds[c], IntegralType)]
    there = {c: f"_there_{c}" for c in whole}
    added = {there[c]: col(c).isNotNull() for c in whole}
    added |= {c: F.coalesce(col(c), F.lit(0).cast(kinds[c])) for c in whole}
    key_columns = []
    for i, key in enumerate(keys):
        # instants, as a local time may come twice
        exact = F.unix_micros(col(key)) if isinstance(kinds[key], TimestampType) else col(key)
        if isinstance(kinds[key], (IntegralType, TimestampType)):
            exact = F.coalesce(exact, F.lit(0))
        added |= {f"_key_{i}": exact, f"_keyed_{i}": col(key).isNotNull()}
        key_columns += [f"_key_{i}", f"_keyed_{i}"]
    added["_bucket"] = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(BUCKETS))
    rows = readings.withColumns(added)
    columns = [*kinds, *there.values()]
    found = rows.groupBy("_bucket").applyInPandasWithState(
        _bucket_step(
            columns,
            key_columns,
            [c for c in (there.get(value), value) if c],
            [c for name in order for c in (there.get(name), name) if c],
        ),
        outputStructType=rows.select(*[col(c) for c in columns]).schema,
        stateStructType="last binary",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
    return found.select(
        *[F.when(col(there[c]), col(c)).alias(c) if c in there else col(c) for c in kinds]
    )


def changes_only(
    readings: DataFrame,
    keys: Sequence[str] = tuple(schemas.READING_KEY),
    value: str = "metric_value",
    order: Sequence[str] = ("time",),
    keep_ms: int | None = None,
) -> DataFrame:
    """Rows of a stream whose `value` differs from the last one of their key.

    Within a batch `order` tells which row is the later one; between batches the batch does.  Null is a
    value as any other.  A key without rows for `keep_ms` milliseconds is forgotten, and its next row
    is a change; without `keep_ms` it is kept for ever.  With `keep_ms` the stream has always another batch
    to look for such keys, so it is to be run at intervals (`once=False`), not up to its end.  The rows of
    one bucket (with `keep_ms`: of one key) in one batch must fit into a task, which the limits of the
    stream's source ensure.
    """
    plain = not any(isinstance(readings.schema[c].dataType, NESTED) for c in (*keys, value))
    if keep_ms is None and keys and order and plain:
        return _by_buckets(readings, keys, value, order)
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    kind = readings.schema[value].dataType.simpleString()
    return readings.groupBy(*[F.col(f"`{k}`") for k in keys]).applyInPandasWithState(
        _step(readings.columns, value, order, keep_ms),
        outputStructType=readings.schema,
        stateStructType=f"value {kind}",
        outputMode="append",
        timeoutConf=timeout,
    )


def start(
    changes: DataFrame, path: str, checkpoint: str, once: bool = True, seconds: int = 60
) -> StreamingQuery:
    """Write a stream of changes to a folder of parquet files."""
    writer = changes.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.option("path", path).outputMode("append")
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()
