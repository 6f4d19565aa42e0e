"""Replacements that stop anywhere, versions of several checkpoints, and ties."""

import threading
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from energylake import schemas
from energylake.sources import generations, tables
from energylake.streaming import changes, sync

from .test_tables import FEB, JAN, MAR, Crash, readings

KEY = schemas.READING_KEY


def values(df):
    return sorted((r["time"], r["site_id"], r["metric_value"]) for r in df.collect())


OLD = [(JAN, "a", 1.0), (FEB, "a", 2.0), (MAR, "a", 3.0)]
NEW = [(JAN, "a", 10.0), (FEB, "a", 2.0), (FEB, "b", 20.0), (MAR, "a", 3.0)]
CHANGE = [(JAN, "a", 10), (FEB, "b", 20)]


def stopping(monkeypatch, module, name, calls=0):
    """`module.name` works `calls` times, then fails."""
    real, done = getattr(module, name), []

    def step(*args, **kwargs):
        if len(done) == calls:
            raise Crash(name)
        done.append(name)
        return real(*args, **kwargs)

    monkeypatch.setattr(module, name, step)


@pytest.mark.parametrize(
    ("step", "seen"),
    [("commit", OLD), ("move_in", OLD), ("switch", OLD), ("drop_old", NEW), ("close", NEW)],
)
def test_readers_see_old_or_new_rows_wherever_an_upsert_stops(spark, tmp_path, monkeypatch, step, seen):
    path = str(tmp_path / "t")
    tables.upsert(readings(spark, *OLD), path, KEY)
    with monkeypatch.context() as patch:
        stopping(patch, generations, step)
        with pytest.raises(Crash):
            tables.upsert(readings(spark, *CHANGE), path, KEY)
    later = [(MAR, "z", 7.0)]
    assert values(tables.scan_training_data(spark, path)) == seen
    assert values(tables.scan_readings(spark, path, JAN, MAR)) == seen
    # rows that come in meanwhile are seen in either case
    tables.append(readings(spark, *later), path)
    assert values(tables.table(spark, path)) == sorted(seen + later)
    if step == "commit":
        tables.upsert(readings(spark, *CHANGE), path, KEY)
    else:
        tables.finish_pending(spark, path)
    assert values(tables.table(spark, path)) == sorted(NEW + later)
    # plain readers too, once the replacement is complete
    assert values(spark.read.parquet(path)) == sorted(NEW + later)


def test_moves_that_stop_in_between(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    tables.upsert(readings(spark, *OLD), str(path), KEY)
    with monkeypatch.context() as patch:
        stopping(patch, generations, "move_in")
        with pytest.raises(Crash):
            tables.upsert(readings(spark, *CHANGE), str(path), KEY)
    (staged,) = (tmp_path / "t_pending" / "data" / "month_start=2024-01-01").glob("*.parquet")
    staged.rename(path / "month_start=2024-01-01" / staged.name)
    assert values(tables.table(spark, str(path))) == OLD
    tables.finish_pending(spark, str(path))
    assert values(tables.table(spark, str(path))) == NEW


def test_deletes_that_stop_in_between(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    tables.upsert(readings(spark, *OLD), str(path), KEY)
    with monkeypatch.context() as patch:
        stopping(patch, generations, "drop_old")
        with pytest.raises(Crash):
            tables.upsert(readings(spark, *CHANGE), str(path), KEY)
    journal = generations.read_journal(spark, str(path))
    (tmp_path / "t" / journal.old[0].split("/t/")[1]).unlink()
    assert values(tables.table(spark, str(path))) == NEW


def test_first_write_that_stops_shows_no_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with monkeypatch.context() as patch:
        stopping(patch, generations, "switch")
        with pytest.raises(Crash):
            tables.upsert(readings(spark, *OLD), path, KEY)
    assert values(tables.table(spark, path)) == []
    tables.finish_pending(spark, path)
    assert values(tables.table(spark, path)) == OLD


def test_a_reader_lists_again_when_the_table_changes(spark, tmp_path, monkeypatch):
    """A whole replacement between the look at the state and the listing."""
    path = str(tmp_path / "t")
    tables.upsert(readings(spark, *OLD), path, KEY)
    real, seen = generations.state, []

    def state(*args):
        found = real(*args)
        seen.append(found.number)
        if len(seen) == 1:
            monkeypatch.setattr(generations, "state", real)
            tables.upsert(readings(spark, *CHANGE), path, KEY)
            monkeypatch.setattr(generations, "state", state)
        return found

    monkeypatch.setattr(generations, "state", state)
    assert values(generations.table(spark, path)) == NEW
    assert len(seen) == 3 and seen[0] < seen[1]


def test_readers_beside_many_upserts(spark, tmp_path):
    """No reader sees a key twice, or none of it, while the table is replaced again and again."""
    path = str(tmp_path / "t")
    rows = readings(spark, *[(JAN, f"s{i}", 0) for i in range(50)])
    tables.upsert(rows, path, KEY, keep_old=True)
    done, failed = threading.Event(), []

    def write() -> None:
        try:
            for n in range(1, 6):
                tables.upsert(rows.withColumn("metric_value", F.lit(float(n))), path, KEY, keep_old=True)
        except Exception as error:
            failed.append(error)
        finally:
            done.set()

    writer = threading.Thread(target=write)
    writer.start()
    looks = []
    while not done.is_set() or not looks:
        found = values(tables.table(spark, path))
        looks.append({v for *_, v in found})
        assert len(found) == 50 and len(looks[-1]) == 1
    writer.join()
    assert not failed
    assert [max(x) for x in looks] == sorted(max(x) for x in looks)


def test_kept_files_serve_running_readers_until_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(readings(spark, *OLD), path, KEY)
    running = tables.scan_training_data(spark, path)
    tables.upsert(readings(spark, *CHANGE), path, KEY, keep_old=True)
    assert values(running) == OLD
    assert values(tables.table(spark, path)) == NEW
    # another replacement takes the rows that count, not the kept ones
    tables.upsert(readings(spark, (JAN, "a", 11)), path, KEY, keep_old=True)
    after = [(JAN, "a", 11.0), *NEW[1:]]
    assert values(tables.table(spark, path)) == after
    now = datetime.now()
    assert tables.vacuum(spark, path, now - timedelta(hours=1)) == 0
    assert tables.vacuum(spark, path, now + timedelta(hours=1)) == 3
    assert values(spark.read.parquet(path)) == values(tables.table(spark, path)) == after


def stream(spark, root, name, rows, **options):
    rows.coalesce(1).write.mode("append").parquet(f"{root}/{name}")
    sync.start_readings_sync(
        spark.readStream.schema(rows.schema).parquet(f"{root}/{name}"),
        f"{root}/t", f"{root}/c-{name}", **options,
    ).awaitTermination()


def test_a_later_checkpoint_wins(spark, tmp_path):
    for value in (1, 2):
        stream(spark, tmp_path, "first", readings(spark, (JAN, "a", value)))
    stream(spark, tmp_path, "second", readings(spark, (JAN, "a", 0)))
    path = f"{tmp_path}/t"
    assert values(sync.synced_readings(spark, path)) == [(JAN, "a", 0.0)]
    # the first one goes on, with versions below those of the second
    stream(spark, tmp_path, "first", readings(spark, (JAN, "a", 9), (FEB, "a", 9)))
    want = [(JAN, "a", 0.0), (FEB, "a", 9.0)]
    assert values(sync.synced_readings(spark, path)) == want
    tables.compact(spark, path, KEY, tables.VERSION)
    assert values(sync.synced_readings(spark, path)) == want


def test_epochs_are_taken_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    found = [generations.epoch(spark, path, f"{tmp_path}/c{c}") for c in (1, 2, 1, 3, 2)]
    assert found == [0, 1, 0, 2, 1]
    # one that was claimed by a job that died before it noted it
    (tmp_path / "t_epochs" / "3").touch()
    assert generations.epoch(spark, path, f"{tmp_path}/c4") == 4


@pytest.mark.parametrize("arrival", [None, "at"])
def test_the_last_row_of_a_batch_wins_before_and_after_compaction(spark, tmp_path, arrival):
    rows = [(JAN, "a", 5), (JAN, "a", 3), (FEB, "a", 1), (FEB, "a", 2)]
    df = readings(spark, *rows).coalesce(1)
    want = [(JAN, "a", 3.0), (FEB, "a", 2.0)]
    if arrival:
        # the column says the opposite of the order of the rows
        df = df.withColumn("at", F.timestamp_seconds(100 - F.monotonically_increasing_id()))
        want = [(JAN, "a", 5.0), (FEB, "a", 1.0)]
    stream(spark, tmp_path, "in", df, arrival=arrival)
    path = f"{tmp_path}/t"
    assert "at" not in spark.read.parquet(path).columns
    assert values(sync.synced_readings(spark, path)) == want
    tables.compact(spark, path, KEY, tables.VERSION)
    assert spark.read.parquet(path).count() == 2
    assert values(sync.synced_readings(spark, path)) == want


def test_ties_of_a_version_are_settled_alike(spark, tmp_path):
    """Without arrival: scans, compaction and upserts all take the greatest value."""
    rows = readings(spark, (JAN, "a", 5), (JAN, "a", 3)).withColumn(tables.VERSION, F.lit(1).cast("long"))
    path = f"{tmp_path}/t"
    tables.append(rows.repartition(2), path)
    assert values(tables.scan_readings(spark, path, JAN, MAR)) == [(JAN, "a", 5.0)]
    assert values(tables.current(spark.read.parquet(path), KEY, tables.VERSION)) == [(JAN, "a", 5.0)]
    tables.compact(spark, path, KEY, tables.VERSION)
    assert values(tables.scan_readings(spark, path, JAN, MAR)) == [(JAN, "a", 5.0)]
    tables.upsert(rows, f"{tmp_path}/u", KEY, tables.VERSION)
    assert values(spark.read.parquet(f"{tmp_path}/u")) == [(JAN, "a", 5.0)]


def run_changes(spark, root, batches, **options):
    schema = "step int, name string, value double"
    for batch in batches:
        df = spark.createDataFrame(batch, schema)
        df.repartition(3).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        found = changes.changes_only(stream, ["name"], "value", ["step"], **options)
        changes.start(found, f"{root}/out", f"{root}/c").awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{root}/out").collect()), key=str)


def plain_changes(batches):
    last, out = {}, []
    for batch in batches:
        for step, name, value in sorted(batch, key=lambda r: r[0]):
            if name not in last or last[name] != value:
                out.append((step, name, value))
            last[name] = value
    return sorted(out, key=str)


def test_a_value_that_comes_back_is_a_change(spark, tmp_path):
    a, b = 1.5, 2.5
    batches = [
        [(0, "x", a), (1, "x", a), (2, "x", b), (3, "x", a), (0, "y", None), (1, "y", None)],
        [(4, "x", a), (5, "x", b), (2, "y", a), (3, "y", None), (0, None, a)],
        [(6, "x", a), (4, "y", None), (7, "x", a), (1, None, a), (2, None, b)],
    ]
    got = run_changes(spark, tmp_path, batches)
    assert got == plain_changes(batches)
    assert [v for _, n, v in sorted(got, key=lambda r: r[0]) if n == "x"] == [a, b, a, b, a]


def test_many_keys_are_compared_at_once(spark, tmp_path):
    """A call for every bucket, not for every key; great whole numbers and nulls stay what they are."""
    big = 2**60
    schema = "step int, id long, at timestamp, value long"
    rows = [(0, big + i if i else None, datetime(2024, 1, 1), None if i % 3 == 0 else big + i) for i in range(3000)]
    again = [(1, i, at, v if i and i % 2 else 7) for _, i, at, v in rows]
    calls = spark.sparkContext.accumulator(0)
    made = changes._bucket_step

    def counted(*args):
        step = made(*args)

        def run(*group):
            calls.add(1)
            yield from step(*group)

        return run

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(changes, "_bucket_step", counted)
        patch.setattr(changes, "BUCKETS", 5)
        for batch in (rows, again):
            spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            found = changes.changes_only(stream, ["at", "id"], "value", ["step"])
            changes.start(found, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {*rows, *[r for r, old in zip(again, rows) if r[3] != old[3]]}
    assert calls.value == 10


class KeyState:
    """State of one key, as a stream hands it over."""

    def __init__(self):
        self.value, self.hasTimedOut, self.waits = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.waits = ms


def test_forgotten_keys_change_again():
    step = changes._step(["name", "value"], "value", ["value"], keep_ms=60_000)
    state, rows = KeyState(), pd.DataFrame({"name": ["x"], "value": [1.0]})

    def run():
        return [len(out) for out in step(("x",), iter([rows]), state)]

    assert run() == [1] and state.waits == 60_000
    assert run() == [0]
    state.hasTimedOut = True
    assert list(step(("x",), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert run() == [1]
