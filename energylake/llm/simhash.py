"""SimHash near-duplicates by the bit counts of segments.

A fingerprint is cut into 32 segments of two bits; their bit counts (0, 1 or 2) are a
point in space.  The Manhattan distance of two points is never more than the number of
bits in which the fingerprints differ, so close fingerprints are close points.  The
space is split into parts such that two points within the limit are within
distance 2 in one part at least; two such points have a common lattice neighbour.  Each
fingerprint therefore enters, for each part, the cell of its point and the cells of the
points one step away, and all linked pairs meet in some cell.  There they are verified bit by bit.

No pairs leave a cell: what it finds is reduced to a spanning forest, at most one link
per member.  Cells above a block's size are compared block by block in tasks of
their own, so one large group of near copies is no single task either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_arrow
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: members of a cell that one task compares with each other
BLOCK = 8192
#: links a task holds before it reduces them to a forest
HELD = 1_000_000

ODD = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits of a text: each is set if it is set in over half its shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: -(shingle - 1) or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 14):
        some = zip(starts[i : i + (1 << 14)].tolist(), ends[i : i + (1 << 14)].tolist(), strict=True)
        digests = b"".join([xxhash.xxh64_digest(line[b:e], SEED) for b, e in some])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(id, code, fp) of every row; fp is the fingerprint as a signed long, code a
    hash of the text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            signed = np.array(fps, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(signed)], ["id", "code", "fp"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("code"), F.col(text_col).alias("text")
    )
    return map_arrow(rows, run, f"id {kind}, code long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in the segment's own place."""
    return fps - ((fps >> np.uint64(1)) & ODD)


def part_segments(max_bits: int) -> list[range]:
    """Segments of each part: with max_bits // 3 + 1 parts, two fingerprints within
    `max_bits` are within distance 2 in one of them."""
    n = max_bits // 3 + 1
    return [range(32 * k // n, 32 * (k + 1) // n) for k in range(n)]


def cells_of(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, cells, fingerprints): the own cell and those one step away."""
    points = segment_counts(fps)
    for part, segments in enumerate(part_segments(max_bits)):
        mask = np.uint64(sum(3 << 2 * s for s in segments))
        own = points & mask
        cells, owners = [own], [fps]
        for s in segments:
            step = np.uint64(1 << 2 * s)
            here = own >> np.uint64(2 * s) & np.uint64(3)
            up, down = here < 2, here > 0
            cells += [own[up] + step, own[down] - step]
            owners += [fps[up], fps[down]]
        yield part, np.concatenate(cells), np.concatenate(owners)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the least of its component instead of the given ones."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


class _Links:
    """Links of one task, reduced to a forest whenever they are many."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits
        self.a = [np.zeros(0, np.uint64)]
        self.b = [np.zeros(0, np.uint64)]
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(a ^ b) <= self.max_bits
        if near.any():
            self.a.append(a[near])
            self.b.append(b[near])
            self.held += int(near.sum())
            if self.held > HELD:
                self.reduce()

    def reduce(self) -> None:
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b = [a], [b]
        # what a forest needs is not counted again
        self.held = 0

    def within(self, cell: np.ndarray, fps: np.ndarray) -> None:
        """All pairs of equal cell; cells stand together."""
        at, shift = np.arange(len(cell) - 1), 1
        while len(at := at[: np.searchsorted(at, len(cell) - shift)]):
            at = at[cell[at] == cell[at + shift]]
            self.add(fps[at], fps[at + shift])
            shift += 1

    def across(self, left: np.ndarray, right: np.ndarray) -> None:
        for x in left:
            self.add(np.full(len(right), x), right)

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        self.reduce()
        return self.a[0].astype(np.int64), self.b[0].astype(np.int64)


LINK, MEMBER = 0, 1
FOUND = "kind int, a long, b long, part int, block long"


def _found(kind: int, a: np.ndarray, b: np.ndarray, part: int = 0, block: int = 0) -> pa.RecordBatch:
    n = len(a)
    columns = [
        pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b),
        pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, block, np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "part", "block"])


def _compare(max_bits: int, size: int):
    """Links within the cells of a sorted partition.  Of a cell with more than `size`
    members, those are passed on instead, numbered by block: kind MEMBER, a the cell,
    b the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links(max_bits)
        part = np.zeros(0, np.int64)
        cell = fps = np.zeros(0, np.int64)
        passed: tuple[int, int] | None = None
        block = 0

        def finish(part, cell, fps):
            """A run of whole cells; the first may be the one that is passed on."""
            nonlocal passed, block
            change = np.flatnonzero((part[1:] != part[:-1]) | (cell[1:] != cell[:-1])) + 1
            bounds = np.concatenate([[0], change, [len(cell)]])
            sizes = np.diff(bounds)
            small = np.ones(len(cell), bool)
            for k in np.flatnonzero(sizes > size).tolist() + [0]:
                b, e = bounds[k], bounds[k + 1]
                own = (int(part[b]), int(cell[b])) if e > b else None
                first = block if k == 0 and own == passed else 0
                if e > b and small[b] and (e - b > size or (own == passed and passed)):
                    for s in range(b, e, size):
                        t = min(e, s + size)
                        yield _found(MEMBER, cell[s:t], fps[s:t], own[0], first + (s - b) // size)
                    small[b:e] = False
            number = np.repeat(np.arange(len(sizes)), sizes)[small]
            links.within(number, fps[small].astype(np.uint64))

        for batch in batches:
            part = np.concatenate([part, batch.column("part").to_numpy()])
            cell = np.concatenate([cell, batch.column("cell").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if not len(cell):
                continue
            # the last cell may go on in the next batch
            last = len(cell) - 1
            same = (part == part[last]) & (cell == cell[last])
            start = len(cell) - int(same.sum())
            if start:
                yield from finish(part[:start], cell[:start], fps[:start])
                part, cell, fps = part[start:], cell[start:], fps[start:]
                passed, block = None, 0
            while len(cell) > size and (passed or len(cell) > 2 * size):
                passed = (int(part[0]), int(cell[0]))
                yield _found(MEMBER, cell[:size], fps[:size], passed[0], block)
                part, cell, fps, block = part[size:], cell[size:], fps[size:], block + 1
        if len(cell):
            yield from finish(part, cell, fps)
        yield _found(LINK, *links.out())

    return run


def _compare_blocks(max_bits: int):
    """Links between two blocks of one cell, or within one; a pair's rows stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links(max_bits)
        key, sides = None, ([], [])

        def solve():
            left, right = (np.array(s, np.int64).astype(np.uint64) for s in sides)
            if len(right):
                links.across(left, right)
            else:
                links.within(np.zeros(len(left), np.int64), left)

        for batch in batches:
            names = ("part", "cell", "low", "high", "side", "fp")
            for *own, side, fp in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if own != key:
                    if key:
                        solve()
                    key, sides = own, ([], [])
                sides[side].append(fp)
        if key:
            solve()
        yield _found(LINK, *links.out())

    return run


def link_forest(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly the
    fingerprints which chains of at most `max_bits` differing bits connect."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().astype(np.uint64)
            for i in range(0, len(every), 20_000):
                for part, cells, owners in cells_of(every[i : i + 20_000], max_bits):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(cells), part, np.int32)),
                            pa.array(cells.astype(np.int64)),
                            pa.array(owners.astype(np.int64)),
                        ],
                        ["part", "cell", "fp"],
                    )

    keys = ["part", "cell"]
    cells = map_arrow(fps.select("fp"), spread, "part int, cell long, fp long")
    sorted_ = cells.repartition(*keys).sortWithinPartitions(*keys)
    found = stage(map_arrow(sorted_, _compare(max_bits, block), FOUND), "found")
    links = found.filter(F.col("kind") == LINK).select("a", "b")
    members = found.filter(F.col("kind") == MEMBER).select(
        "part", F.col("a").alias("cell"), "block", F.col("b").alias("fp")
    )
    blocks = members.groupBy(*keys).agg((F.max("block") + 1).alias("n"))
    keys = ["part", "cell", "low", "high"]
    pairs = (
        members.join(blocks, ["part", "cell"])
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select(
            "part",
            "cell",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
            "fp",
        )
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )
    far = map_arrow(pairs, _compare_blocks(max_bits), FOUND).select("a", "b")
    return links.union(far)


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    block: int = BLOCK,
) -> DataFrame:
    """(id, code, fp, root, component_id) of every row; root is a fingerprint of the group.

    Rows whose fingerprints are linked by a chain have one component, named after its
    smallest id.  Nulls and blank texts have the fingerprint 0 and are linked like any other; a null id
    names no component unless there is no other; repeated rows are rows of their own; no rows give no rows.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fps")
    roots = components(link_forest(distinct, max_bits, block))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row with the smallest id of each group of near duplicates, columns as they were.

    Of rows with equal id and text one stays.  A null id counts as smaller than any other.
    """
    id_col = options.get("id_col", "doc_id")
    text_col = options.get("text_col", "text")
    found = groups(docs, **options)
    chosen = (
        found.groupBy("root", "id", "code")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("root")
        .agg(F.min(F.struct("id", "code", "times")).alias("first"))
        .select("first.*")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("own_id"),
        F.xxhash64(text_col).alias("own_code"),
    )
    stay = rows.join(
        chosen, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_code") == F.col("code"))
    )
    again = stay.filter("times > 1").dropDuplicates(["own_id", "own_code"])
    return stay.filter("times = 1").union(again).select("row.*")
