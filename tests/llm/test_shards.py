"""Best-fit-decreasing sharding."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from energylake.llm import shards

from .conftest import ODD


def simple_best_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            rooms.append(max(capacity, sizes[i]))
            b = len(rooms) - 1
        rooms[b] -= sizes[i]
        out[i] = b
    return out


@pytest.mark.parametrize("seed", range(6))
def test_as_a_plain_scan_would(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 7, 50, 99, rng.randint(1, 120)]) for _ in range(400)]
    assert shards.best_fit_decreasing(sizes, 100) == simple_best_fit(sizes, 100)


def test_tree_stays_balanced():
    root = None
    for i in range(1000):
        root = shards._insert(root, (i, i))
    assert root.height <= 12
    for i in range(0, 1000, 2):
        root = shards._remove(root, (i, i))
    assert root.height <= 12
    assert shards._tightest(root, 500) == (501, 501)
    assert shards._tightest(root, 1000) is None


def test_least_capacity_is_enough():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    capacity = shards.least_capacity(Counter(sizes), 8)
    assert max(shards.best_fit_decreasing(sizes, capacity)) < 8
    assert capacity <= -(-sum(sizes) // 8) + 5


def test_a_plan_on_a_histogram_is_that_of_single_groups(spark):
    """Whatever the size of the table: every group is an item, large or small."""
    rng = random.Random(9)
    rows, text_of = [], {}
    for i in range(3000):
        text = f"text {rng.randint(0, 1500)} " + "x" * rng.choice([0, 3, 3, 3, 40, rng.randint(0, 300)])
        rows.append((i, text))
        text_of[i] = text
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shards.shard_documents(df, shards=5).collect()
    bytes_of, shard_of = defaultdict(int), {}
    for r in got:
        bytes_of[text_of[r.doc_id]] += r.size
        assert shard_of.setdefault(text_of[r.doc_id], r.shard) == r.shard
    sizes = sorted(bytes_of.values(), reverse=True)
    room = shards.least_capacity(Counter(sizes), 5)
    want = Counter(zip(sizes, simple_best_fit(sizes, room)))
    assert Counter((n, shard_of[t]) for t, n in bytes_of.items()) == want


def check(rows, text_of, n):
    """Whole rows, groups together, slots gapless."""
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < n
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return slots


def test_odd_rows(odd):
    rows = shards.shard_documents(odd, shards=3).collect()
    check(rows, None, 3)
    want = sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD
    )
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_no_rows(empty):
    assert shards.shard_documents(empty).collect() == []


def test_equal_bytes_and_whole_groups(documents, texts):
    rows = shards.shard_documents(documents, shards=8).collect()
    check(rows, texts, 8)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    total, shard_of = defaultdict(int), {}
    for r in rows:
        total[r.shard] += r.size
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert max(total.values()) - min(total.values()) <= 0.02 * max(total.values())


def test_hot_group_stays_whole(spark):
    rows = [(i, "the hot text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shards.shard_documents(df, shards=4).collect()
    check(got, None, 4)
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) == 1


def test_fixed_capacity(documents):
    capacity = 20_000
    rows = shards.shard_documents(documents, capacity=capacity).collect()
    sizes = defaultdict(list)
    for r in rows:
        sizes[r.shard].append(r.size)
    total = sum(map(sum, sizes.values()))
    assert all(sum(s) <= capacity or len(set(s)) == 1 for s in sizes.values())
    assert len(sizes) <= 1.3 * total / capacity + 2


def test_written_shards_hold_their_rows(documents, texts, spark, tmp_path):
    placed = shards.write_shards(documents, str(tmp_path / "out"), shards=3)
    shard_of = {r.doc_id: r.shard for r in placed.collect()}
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: r.text for r in back} == texts
    assert len(back) == len(texts)
    assert all(r._shard == shard_of[r.doc_id] for r in back)
