"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal text form a group that never spans two shards.  Groups enter the
packing in order of falling size, each into the open shard whose remaining room
is the least that still holds it; the rooms lie in a balanced search tree.

There can be billions of groups, so the driver sees how many there are of each size, not the groups.
Equal groups follow each other into the tightest shard until it holds no more, so one step places
many, and the outcome is that of packing every group by itself.  Sizes that differ add up, so n bytes have at
most sqrt(2 n) of them.  Groups of a size are numbered in parallel, and the number tells the shard.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ceil_div, join_by_key, map_arrow, numbered


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _balanced(node: _Node) -> _Node:
    """The node after at most two rotations; the heights of its sides differ by one."""
    lean = _height(node.left) - _height(node.right)
    if lean > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _turn_left(node.left)
        return _turn_right(node)
    if lean < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _turn_right(node.right)
        return _turn_left(node)
    node.height = 1 + max(_height(node.left), _height(node.right))
    return node


def _turn_left(node: _Node) -> _Node:
    top = node.right
    node.right, top.left = top.left, node
    node.height = 1 + max(_height(node.left), _height(node.right))
    top.height = 1 + max(_height(top.left), _height(top.right))
    return top


def _turn_right(node: _Node) -> _Node:
    top = node.left
    node.left, top.right = top.right, node
    node.height = 1 + max(_height(node.left), _height(node.right))
    top.height = 1 + max(_height(top.left), _height(top.right))
    return top


def _insert(node: _Node | None, key: tuple[int, int]) -> _Node:
    if node is None:
        return _Node(key)
    if key < node.key:
        node.left = _insert(node.left, key)
    else:
        node.right = _insert(node.right, key)
    return _balanced(node)


def _remove(node: _Node, key: tuple[int, int]) -> _Node | None:
    if key < node.key:
        node.left = _remove(node.left, key)
    elif key > node.key:
        node.right = _remove(node.right, key)
    elif node.left is None or node.right is None:
        return node.left or node.right
    else:
        least = node.right
        while least.left:
            least = least.left
        node.key = least.key
        node.right = _remove(node.right, least.key)
    return _balanced(node)


def _tightest(node: _Node | None, size: int) -> tuple[int, int] | None:
    """The least (room, bin) with room for `size`."""
    found = None
    while node:
        if node.key[0] >= size:
            found, node = node.key, node.left
        else:
            node = node.right
    return found


def best_fit_runs(
    histogram: dict[int, int], capacity: int, most: int | None = None
) -> list[tuple[int, int, int]] | None:
    """(size, number of the first, bin): where the groups of each size go, by their numbers.

    A size above the capacity gets bins of its own.  None if more than `most` bins are needed.
    """
    rooms: _Node | None = None
    runs = []
    opened = 0
    for size in sorted(histogram, reverse=True):
        placed, all_of_size = 0, histogram[size]
        while placed < all_of_size:
            found = _tightest(rooms, size)
            if found is None:
                if opened == most:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            else:
                rooms = _remove(rooms, found)
            # what is left of the room is the tightest again as long as it holds one more
            times = min(all_of_size - placed, found[0] // size) if size else all_of_size - placed
            runs.append((size, placed, found[1]))
            rooms = _insert(rooms, (found[0] - times * size, found[1]))
            placed += times
    return runs


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; of equal ones the first come first."""
    starts, numbers, bins = defaultdict(list), Counter(), []
    for size, first, b in best_fit_runs(Counter(sizes), capacity):
        starts[size].append((first, b))
    for size in sizes:
        bins.append([b for first, b in starts[size] if first <= numbers[size]][-1])
        numbers[size] += 1
    return bins


def least_capacity(histogram: dict[int, int], shards: int) -> int:
    """The smallest capacity found with which `shards` bins are enough.

    It lies little above an equal share as a rule, so steps from there grow until one is enough, then halve.
    """
    total = sum(size * n for size, n in histogram.items())
    low = max([ceil_div(total, shards), *histogram])
    step, high = 0, low
    while best_fit_runs(histogram, high, shards) is None:
        low, step = high + 1, max(1, 2 * step)
        high += step
    while low < high:
        middle = (low + high) // 2
        if best_fit_runs(histogram, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return high


def _assigned(groups: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
    """`groups` (group, bytes, n, k) with the shard that the k-th group of its size goes to."""
    table = np.array(sorted(runs) or [(0, 0, 0)], np.int64)
    shared = groups.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, shard = shared.value.T
        starts, where = np.unique(size, return_index=True)
        ends = np.append(where[1:], len(size))
        for batch in batches:
            own = np.searchsorted(starts, batch.column("bytes").to_numpy())
            k = batch.column("k").to_numpy()
            # the last run of the size that starts at k or before, by halving
            low, high = where[own], ends[own] - 1
            while (low < high).any():
                middle = (low + high + 1) // 2
                fits = first[middle] <= k
                low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), batch.column("n"), pa.array(shard[low].astype(np.int32))],
                ["group", "n", "shard"],
            )

    return map_arrow(groups, run, "group long, n long, shard int")


def shard_documents(
    docs: DataFrame,
    shards: int | None = 8,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shard and place in it of every row; rows with equal text stay together.

    Give `shards` for so many shards of about equal bytes, or `capacity` for as
    few shards of so many bytes as the packing finds.  Returns `id_col`, size
    (bytes of the text plus 1), text_crc32, shard and slot (gapless from 0 in each
    shard).  A null text counts as an empty one; rows with a null or repeated id
    are rows as any other; an empty table gives no rows.  Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("group"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "shard-rows",
    )
    groups = stage(
        rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")),
        "shard-groups",
    )
    histogram = {
        r.bytes: r.n for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    room = capacity or (least_capacity(histogram, shards) if histogram else 1)
    ranked = numbered(groups.withColumn("row_no", F.col("group")), ["bytes"], [], "k")
    placed = stage(
        _assigned(ranked.select("group", "bytes", "n", "k"), best_fit_runs(histogram, room)),
        "shard-plan",
    )
    dealt = stage(
        join_by_key(rows, placed, "group", "n").select("id", "size", "crc", "row_no", "shard"),
        "shard-dealt",
    )
    return numbered(dealt, ["shard"], ["id"], "slot").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the documents with one folder per shard; returns the placement.

    Rows are matched to the placement by id and text, so rows of one id and
    different texts go where each belongs.
    """
    id_col = options.get("id_col", "doc_id")
    text_col = options.get("text_col", "text")
    placed = stage(shard_documents(docs, **options), "placed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    where = placed.select(
        F.col(id_col).alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"),
        F.col("shard").alias("_shard"),
    ).distinct()
    (
        docs.withColumn("_key", F.crc32(text))
        .withColumn("_bytes", F.octet_length(text) + 1)
        .join(
            where,
            F.col(id_col).eqNullSafe(F.col("_id"))
            & (F.col("_key") == F.col("_crc"))
            & (F.col("_bytes") == F.col("_size")),
        )
        .drop("_id", "_crc", "_size", "_key", "_bytes")
        .write.partitionBy("_shard")
        .parquet(path)
    )
    return placed
