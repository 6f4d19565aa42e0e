"""Vectors as short codes of their parts, with nearest entries looked up by grid cell.

A vector is cut into equal parts.  Each part is given the number of the entry
of its codebook that lies nearest; a codebook is fitted by a few rounds of means.  To find
nearest entries without measuring all of them, space is cut into boxes.  A part's box
is known by its hash, and for each box met the entries that can be nearest to some point of it
are remembered: those whose least distance from the box is not above another entry's greatest one.
Only these are measured.  Everything is in whole numbers, so the result does not depend on
how the rows are dealt over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ceil_div, join_by_key, map_arrow
from .grids import extent, matrix, whole_vectors

#: boxes remembered for each part position; beyond that the memory starts anew
MEMORY = 1 << 15
#: numbers that one step of the measuring holds
STEP = 1 << 21


class CellMemory:
    """Nearest entries of one codebook, by boxes of `edge` whole numbers along each axis."""

    def __init__(self, book: np.ndarray, memory: int = MEMORY) -> None:
        self.book = book
        # about one box per standard deviation of the entries
        self.edge = max(1, int(book.std())) if book.size else 1
        self.memory = memory
        self.known: dict[bytes, int] = {}
        self.candidates: list[np.ndarray] = []
        self.measured = 0

    def _not_dominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries, in rising order, that can be nearest to some point of each box."""
        out = []
        step = max(1, STEP // max(1, self.book.size))
        for i in range(0, len(cells), step):
            low = (cells[i : i + step] * self.edge)[:, None, :]
            high = low + self.edge - 1
            below, above = low - self.book, self.book - high
            least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
            out += [np.flatnonzero(row) for row in least <= most.min(axis=1)[:, None]]
        return out

    def _look_up(self, cells: np.ndarray) -> list[np.ndarray]:
        """Candidates of each box, worked out for those not met before."""
        keys = [cell.tobytes() for cell in cells]
        new = [i for i, key in enumerate(keys) if key not in self.known]
        if len(self.known) + len(new) > self.memory:
            self.known, self.candidates, new = {}, [], list(range(len(keys)))
        for i, found in zip(new, self._not_dominated(cells[new]), strict=True):
            self.known[keys[i]] = len(self.candidates)
            self.candidates.append(found)
        return [self.candidates[self.known[key]] for key in keys]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part; ties go to the lower entry."""
        entry = np.zeros(len(parts), np.int64)
        squared = np.zeros(len(parts), np.int64)
        cells = np.ascontiguousarray(parts // self.edge)
        if not cells.shape[1]:
            return entry, squared
        packed = cells.view(f"V{cells.itemsize * cells.shape[1]}").ravel()
        _, first, box = np.unique(packed, return_index=True, return_inverse=True)
        found = self._look_up(cells[first])
        counts = np.array([len(c) for c in found])
        # boxes with about as many candidates are measured together
        classes = np.ceil(np.log2(counts)).astype(int)
        for c in np.unique(classes):
            members = np.flatnonzero(classes == c)
            width = counts[members].max()
            table = np.zeros((len(found), width), np.int64)
            for m in members:
                # the first one stands for those that are missing, and wins ties with itself
                table[m] = found[m][0]
                table[m, : len(found[m])] = found[m]
            rows = np.flatnonzero(classes[box] == c)
            self.measured += len(rows) * width
            step = max(1, STEP // (width * parts.shape[1]))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                options = table[box[some]]
                d = ((parts[some, None, :] - self.book[options]) ** 2).sum(axis=2)
                best = d.argmin(axis=1)
                entry[some] = options[np.arange(len(some)), best]
                squared[some] = d[np.arange(len(some)), best]
        return entry, squared


def _parts(column: pa.Array, books: np.ndarray) -> np.ndarray:
    """(row, part, position) of the vectors of a batch."""
    parts, _, width = books.shape
    return matrix(column, parts * width).reshape(len(column), parts, width)


def _first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(part, entry, position): the vectors of the smallest ids; of a repeated id the least one."""
    order = F.asc_nulls_last("id")
    ids = rows.select("id").distinct().orderBy(order).limit(entries)
    chosen = (
        rows.join(F.broadcast(ids.withColumnRenamed("id", "_id")), F.col("id").eqNullSafe(F.col("_id")))
        .groupBy("id")
        .agg(F.min("x").alias("x"))
        .orderBy(order)
        .collect()
    )
    base = np.zeros((len(chosen), parts * width), np.int64)
    for row, c in zip(base, chosen, strict=True):
        row[: len(c.x)] = c.x
    return base.reshape(len(chosen), parts, width).transpose(1, 0, 2)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at the floored mean of the parts nearest to it; unused ones stay."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memories = [CellMemory(book) for book in shared.value]
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _parts(batch.column("x"), shared.value)
            for p, memory in enumerate(memories):
                entry, _ = memory.nearest(x[:, p])
                np.add.at(sums[p], entry, x[:, p])
                np.add.at(counts[p], entry, 1)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"],
        )

    # a task gives at most one row per entry; they are added up before they reach the driver
    sums = (
        map_arrow(rows.select("x"), run, "part int, entry int, n long, total array<long>")
        .select("part", "entry", "n", F.posexplode("total").alias("position", "value"))
        .groupBy("part", "entry", "position")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        .collect()
    )
    moved = books.copy()
    for r in sums:
        moved[r.part, r.entry, r.position] = r.value // r.n
    return moved


def fit(
    rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, width: int | None = None
) -> np.ndarray:
    """Codebooks (part, entry, position) of staged rows (id, x)."""
    if width is None:
        width = ceil_div(extent(rows)[0], parts)
    books = _first_books(rows, parts, entries, width)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """`rows` with code (two hex digits a part) and error (squared distances, summed) in place of x."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    others = [c for c in rows.columns if c != "x"]
    if books.shape[1] > 256:
        raise ValueError("two hex digits name 256 entries at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memories = [CellMemory(book) for book in shared.value]
        for batch in batches:
            x = _parts(batch.column("x"), shared.value)
            code = np.zeros(x.shape[:2], np.uint8)
            error = np.zeros(len(x), np.int64)
            for p, memory in enumerate(memories):
                entry, squared = memory.nearest(x[:, p])
                code[:, p] = entry
                error += squared
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
                [*others, "code", "error"],
            )

    schema = rows.select(*others).schema.add("code", "string").add("error", "long")
    return map_arrow(rows, run, schema)


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code", out: str = "vector") -> DataFrame:
    """`codes` with the vector that each code stands for, in the whole numbers of the codebooks."""
    parts, entries, _ = books.shape
    flat = [[list(map(int, e)) for e in book] for book in books]
    table = F.lit(0) if not entries else F.array(*[F.array(*[F.array(*map(F.lit, e)) for e in b]) for b in flat])
    if not entries:
        return codes.withColumn(out, F.array().cast("array<long>"))
    number = lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int")
    each = [F.get(table[p], number(p)) for p in range(parts)]
    return codes.withColumn(out, F.concat(*each).cast("array<long>"))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(`id_col`, code, error, label_error, codebooks_sha256) of every vector.

    Codebooks start at the vectors of the smallest ids (null ids last, as one id; of rows that share an id
    the least vector), as many as there are.  Rows without vector or with a null or
    non-finite component are left out; rows with null or repeated ids are coded like others.
    Vectors shorter than the longest, or than a multiple of `parts`, count as filled up with zeros.
    Null labels are one label.  Other columns are not looked at; an empty table gives no rows.
    """
    rows = stage(
        whole_vectors(vectors, scale, vector_col, id=id_col, label=label_col), "grid-vectors"
    )
    books = fit(rows, parts, entries, rounds)
    coded = stage(encode(rows, books), "grid-codes")
    labels = stage(
        coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")),
        "grid-labels",
    )
    return join_by_key(coded, labels, "label", "n").select(
        F.col("id").alias(id_col), "code", "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )
