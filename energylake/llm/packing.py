"""Packing token sequences by minimum bin slack.

For one bin after another, a subset-sum over the lengths still there finds the fullest
feasible combination that holds the longest piece; it is removed and the next bin
follows.  Pieces of equal length are alike, so the search runs on a histogram of at
most `capacity` lengths whatever the number of pieces, and a combination is taken as
often as the counts allow.  Which piece takes which place follows from its number
among the pieces of its length; those numbers are worked out in parallel, also if one
length holds most pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_arrow, numbered
from .tokens import word_encoder

CAPACITY = 4096
END_ID = 1


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a sub-multiset of `counts` whose sum comes closest to `room`.

    Bit s of `reach` says that sum s can be made.  Longer pieces come first, and the
    search ends when the room can be filled.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left = min(counts[length], room // length)
        times = 1
        while left and not reach >> room & 1:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations and how many bins each fills, until no piece is left."""
    left = {x: n for x, n in histogram.items() if n}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest(left, capacity - longest)
        left[longest] += 1
        combination = dict(rest)
        combination[longest] = combination.get(longest, 0) + 1
        repeat = min(left[x] // n for x, n in combination.items())
        for x, n in combination.items():
            left[x] -= n * repeat
            if not left[x]:
                del left[x]
        bins.append((sorted(combination.items(), reverse=True), repeat))
    return bins


def segments(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces of a length with numbers from `rank` on go to the
    bins from `first` on, `times` to each, at `offset` and after."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for combination, repeat in bins:
        offset = 0
        for length, times in combination:
            rank = used.get(length, 0)
            rows.append((length, rank, first, times, offset))
            used[length] = rank + times * repeat
            offset += length * times
        first += repeat
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "first", "times", "offset"), table.T, strict=True))


def pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's ids and the end id, cut where they exceed the capacity.

    Columns: id, piece, start, length, ids_crc32, and ids if asked for.
    """
    tail = end_id.to_bytes(4, "little")
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=False)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        step = 4 * capacity
        for batch in batches:
            rows, held = [], 0
            texts = (t.as_py() for t in batch.column(1))
            for doc, coded in zip(batch.column(0), encoder.encode(texts), strict=True):
                coded += tail
                for k, at in enumerate(range(0, len(coded), step)):
                    part = coded[at : at + step]
                    row = (doc.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
                    held += len(part)
                    if held > 1 << 24:
                        yield batch_of(rows, batch.column(0).type)
                        rows, held = [], 0
            yield batch_of(rows, batch.column(0).type)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, schema + (", ids binary" if with_ids else ""))


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place of every piece of every document in sequences of `capacity` tokens.

    Columns: `id_col`, piece, start, length, ids_crc32, sequence_id, offset, and ids if
    asked for.  A null text counts as an empty one, which has the end id alone; rows with null or
    repeated ids are packed as any other; no rows give no rows; other columns are not
    looked at.
    """
    cut = stage(
        pieces(docs, vocabulary, capacity, end_id, with_ids, id_col, text_col).withColumn(
            "row_no", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    # at most `capacity` rows
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most as many rows as the capacity has combinations of lengths by the plan
    table = segments(plan(histogram, capacity))
    shared = cut.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t["length"] << 44 | t["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            inside = rank - t["rank"][at]
            sequence = t["first"][at] + inside // t["times"][at]
            offset = t["offset"][at] + inside % t["times"][at] * length
            kept = [c for c in batch.schema.names if c not in ("row_no", "rank")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    ranked = numbered(cut.drop("ids"), ["length"], ["id"], "rank").select(
        "id", "piece", "start", "length", "ids_crc32", "row_no", "rank"
    )
    if with_ids:
        ranked = ranked.join(cut.select("row_no", "ids"), "row_no")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""
    out = map_arrow(ranked, run, schema + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' ids, from `pack(..., with_ids=True)`: sequence_id, ids (binary)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate(
            "parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])
        ).alias("ids"),
    )
