"""Token files: one concatenated id array, document boundaries in Elias-Fano code.

A file holds, for documents in ascending id order, the boundaries of their tokens
(ends, never falling) and their ids (never falling either), each as an Elias-Fano
sequence: the low bits of every value side by side, the high bits in unary, and for
every `SAMPLE`-th value the place of its one bit.  A sequence of n values below u
takes about 2 + log2(u / n) bits per value instead of 64, and any value is found by
one look at the samples and a short count of ones.

Layout, all little-endian: magic, version, bytes per token, number of rows, rows
without id, number of tokens, sequence of ends, sequence of ids, tokens.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path, stage
from .common import map_arrow, partitions
from .tokens import word_encoder

MAGIC = b"EFTK"
HEADER = struct.Struct("<4sBBxxQQQ")
SEQUENCE = struct.Struct("<qQBxxxxxxxQQQ")
SAMPLE = 256
#: a file is closed once it holds so many tokens or rows
FILE_TOKENS = 8_000_000
FILE_ROWS = 100_000
#: rows whose bounds are looked up at once
READ_ROWS = 4096


class EliasFano:
    """A never falling sequence of integers."""

    def __init__(self, base: int, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.base, self.n, self.low_bits = base, n, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        base = int(values[0]) if n else 0
        rest = values.astype(np.uint64) - np.uint64(base % (1 << 64))
        top = int(rest[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        # a block of rows at a time: the bits stand in one byte each before packing
        low = np.packbits(
            np.concatenate(
                [
                    ((rest[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
                    for i in range(0, n, 65536)
                ]
                or [np.zeros(0, np.uint8)]
            ),
            bitorder="little",
        )
        ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(base, n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def __getitem__(self, i: int) -> int:
        """The i-th value: a sampled place, then ones counted byte by byte."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        current = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := current.bit_count()) <= left:
            left -= ones
            byte += 1
            current = int(self.high[byte])
        for _ in range(left):
            current &= current - 1
        high = byte * 8 + (current & -current).bit_length() - 1 - i
        start = i * self.low_bits
        part = bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3])
        low = int.from_bytes(part, "little") >> (start & 7) & ((1 << self.low_bits) - 1)
        return _signed(self.base + (high << self.low_bits | low))

    def select(self, first: int, count: int) -> np.ndarray:
        """`count` values from the `first`-th on: the samples tell where their ones lie, and only those bytes
        are looked at."""
        count = max(0, min(count, self.n - first))
        if not count:
            return np.zeros(0, np.int64)
        begin = first // SAMPLE
        byte = int(self.samples[begin]) >> 3
        after = (first + count - 1) // SAMPLE + 1
        end = (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[byte:end], bitorder="little")
        bits[: int(self.samples[begin]) & 7] = 0
        skipped = first - begin * SAMPLE
        ones = np.flatnonzero(bits)[skipped : skipped + count] + 8 * byte
        high = (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low_bits)
        low = np.zeros(count, np.uint64)
        if self.low_bits:
            at = first * self.low_bits
            held = self.low[at >> 3 : (at + count * self.low_bits + 7) >> 3]
            parts = np.unpackbits(held, bitorder="little")[at & 7 :][: count * self.low_bits]
            parts = parts.reshape(count, self.low_bits)
            for k in range(self.low_bits):
                low |= parts[:, k].astype(np.uint64) << np.uint64(k)
        return ((high | low) + np.uint64(self.base % (1 << 64))).astype(np.int64)

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.select(0, self.n)

    def to_bytes(self) -> bytes:
        head = SEQUENCE.pack(
            self.base, self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)
        )
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of `data`, and the bytes it takes."""
        base, n, low_bits, n_low, n_high, n_samples = SEQUENCE.unpack_from(data)
        at = SEQUENCE.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u8", n_samples, at + n_low + n_high)
        return cls(base, n, low_bits, low, high, samples), at + n_low + n_high + 8 * n_samples


def _signed(value: int) -> int:
    value %= 1 << 64
    return value - (1 << 64) if value >> 63 else value


def to_file(doc_ids: list[int | None], tokens: list[bytes]) -> bytes:
    """Content of a file.  Rows without id come first; ids must not fall."""
    nameless = sum(i is None for i in doc_ids)
    flat = np.frombuffer(b"".join(tokens), "<u4")
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    ends = np.cumsum([len(t) // 4 for t in tokens], dtype=np.int64)
    return b"".join(
        [
            HEADER.pack(MAGIC, 1, width, len(tokens), nameless, len(flat)),
            EliasFano.of(ends).to_bytes(),
            EliasFano.of(np.array(doc_ids[nameless:], np.int64)).to_bytes(),
            flat.astype(f"<u{width}").tobytes(),
        ]
    )


class TokenFile:
    """A file's rows by place."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, version, self.width, self.rows, self.nameless, self.n_tokens = HEADER.unpack_from(view)
        if (magic, version) != (MAGIC, 1):
            raise ValueError("not a token file")
        at = HEADER.size
        self.ends, size = EliasFano.from_bytes(view[at:])
        at += size
        self.doc_ids, size = EliasFano.from_bytes(view[at:])
        at += size
        self.tokens = np.frombuffer(view, f"<u{self.width}", self.n_tokens, at)

    def bounds(self, row: int) -> tuple[int, int]:
        """Where the row's tokens begin and end in the file's array."""
        return self.ends[row - 1] if row else 0, self.ends[row]

    def slice_bounds(self, first: int, count: int) -> np.ndarray:
        """Where the tokens of so many rows begin, and at last where they end."""
        before = self.ends[first - 1] if first else 0
        return np.concatenate([[before], self.ends.select(first, count)])

    def slice_ids(self, first: int, count: int) -> pa.Array:
        """Document ids of so many rows; null for those without."""
        nameless = max(0, min(count, self.nameless - first))
        named = self.doc_ids.select(max(0, first - self.nameless), count - nameless)
        return pa.concat_arrays([pa.nulls(nameless, pa.int64()), pa.array(named)])

    def doc_id(self, row: int) -> int | None:
        return None if row < self.nameless else self.doc_ids[row - self.nameless]

    def ids(self, row: int) -> np.ndarray:
        begin, end = self.bounds(row)
        return self.tokens[begin:end]


def _store(path: str):
    """File system and path of a URI, for the workers.

    The folder is one all executors share: a mounted one, or a store that Arrow opens.
    """
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    folder: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode all rows and write token files; returns the list of files.

    Rows are range-partitioned by id, sorted, encoded and written in one go, so file
    order is id order.  Rows without id come first, rows of one id stand in the order of their
    texts; a null text is an empty one, which has the end id alone.  No rows give no
    files.  Files are closed at a fixed size, so a task holds one file's content.  A
    repeated task writes the same content under the same name; a file appears under its
    name when it is complete.

    Columns: part, seq (file order), path, n_rows, n_tokens, first (tokens in earlier files).
    """
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_encoder(vocabulary)
        part = TaskContext.get().partitionId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = seq = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, tokens, held, seq
            name = f"{base}/part-{part:06d}-{seq:06d}.eftk"
            attempt = f"{base}/_{uuid.uuid4().hex}"
            with store.open_output_stream(attempt) as out:
                out.write(to_file(ids, tokens))
            store.move(attempt, name)
            row = [[part], [seq], [f"{folder}/{name.rsplit('/', 1)[1]}"], [len(ids)], [held]]
            ids, tokens, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(v) for v in row], ["part", "seq", "path", "n_rows", "n_tokens"]
            )

        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for doc, coded in zip(batch.column(0), encoder.encode(texts), strict=True):
                ids.append(doc.as_py())
                tokens.append(coded + tail)
                held += len(coded) // 4 + 1
                if held >= FILE_TOKENS or len(ids) >= FILE_ROWS:
                    yield close()
        if ids:
            yield close()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(
        partitions(spark), F.col("id").asc_nulls_first(), F.xxhash64("text")
    ).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    schema = "part long, seq long, path string, n_rows long, n_tokens long"
    files = stage(map_arrow(ordered, run, schema), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file, some millions of tokens each
    return files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document of the files that `write_tokens` lists, found by the files' select structures.

    Columns: doc_id, start (tokens of all earlier rows), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0), batch.column(1), strict=True):
                store, place = _store(path.as_py())
                with store.open_input_stream(place) as f:
                    file = TokenFile(f.read())
                for row in range(0, file.rows, READ_ROWS):
                    bounds = file.slice_bounds(row, READ_ROWS)
                    crc = [
                        zlib.crc32(file.tokens[b:e].astype("<u4").tobytes())
                        for b, e in zip(bounds[:-1], bounds[1:], strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            file.slice_ids(row, len(crc)),
                            pa.array(bounds[:-1] + first.as_py()),
                            pa.array(np.diff(bounds)),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = files.select("path", "first").repartition(partitions(files.sparkSession), "path")
    return map_arrow(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the token files of `docs` into the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "token-store")
    return read_tokens(write_tokens(docs, vocabulary, folder, end_id))
