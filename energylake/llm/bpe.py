"""Byte-level BPE: linear-time exact encoding, decoding by an offset table.

Encoding walks over a piece of text from left to right and takes the longest
token that matches, as an Aho-Corasick automaton finds it.  A token may follow
another only if merging the two strings by rank would have kept them apart; if it may
not, the next shorter token is tried, and if none is left the walk goes one token
back.  A bit per position remembers ends that lead nowhere, so no position is
tried twice and the result is the one that merging gives.

Decoding concatenates slices of one byte string; an offset table says where each id's
bytes begin.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: pieces in a generation of a worker's memory, and pairs whose verdict it keeps
MEMORY = 300_000
#: how this kind of vocabulary cuts text before merging; a fixed value
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files.

    Printable Latin-1 bytes stand for themselves, the others for the characters
    from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memory(dict):
    """ids of pieces; one that is not there is taken from the generation before or encoded."""

    def __init__(self, encode, older: dict[str, bytes]):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        self.to_chars = {b: c for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.pieces = regex.compile(PIECES)

        # tokens numbered by the order in which merging makes them
        strings = list(alphabet.values())
        number = {s: i for i, s in enumerate(strings)}
        self.halves = [(i, i) for i in range(len(strings))]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = (number[left], number[right])
            whole = left + right
            if whole not in number:
                number[whole] = len(strings)
                strings.append(whole)
                self.halves.append(pair)
            self.merged.setdefault(pair, number[whole])
        self.length = [len(s) for s in strings]
        self.ids = [vocab[s].to_bytes(4, "little") for s in strings]
        self.shorter = [
            next((number[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in number), -1)
            for s in strings
        ]
        self.automaton = ahocorasick.Automaton()
        for s, i in number.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.known = _Memory(self.encode_piece, {})
        self.compatible: dict[tuple[int, int], bool] = {}

        # the offset table of the decoder
        byte_of = {c: b for b, c in alphabet.items()}
        by_id = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        by_id |= {i: s.encode() for s, i in self.special.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging by rank would leave these two tokens side by side.

        The last merge that formed either token is undone step by step, later merges
        first; if at some step the two tokens at the seam have a merge that
        comes before all undone so far, that merge would have joined them.
        """
        found = self.compatible.get((left, right))
        if found is not None:
            return found
        key, limit, good = (left, right), 1 << 60, None
        while good is None:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                good = False
            elif left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    # a single byte on the left; undo on the right instead
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        good = True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        good = True
        if len(self.compatible) >= MEMORY:
            self.compatible.clear()
        self.compatible[key] = good
        return good

    def encode_piece(self, piece: str) -> bytes:
        """ids of one piece, as little-endian unsigned 32-bit integers."""
        text = piece.encode().decode("latin-1").translate(self.to_chars)
        n = len(text)
        longest = [0] * n
        for end, token in self.automaton.iter(text):
            longest[end - self.length[token] + 1] = token
        dead = bytearray(n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if not dead[end] and (not tokens or self.may_follow(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = longest[at] if at < n else 0
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = tokens.pop()
                at -= self.length[token]
        return b"".join([self.ids[t] for t in tokens])

    def _plain(self, text: str) -> bytes:
        ids = b"".join(map(self.known.__getitem__, self.pieces.findall(text)))
        if len(self.known) > MEMORY:
            self.known.older = {}
            self.known = _Memory(self.encode_piece, self.known)
        return ids

    def encode(self, text: str) -> bytes:
        """ids of a whole text; names of special tokens in it become their ids."""
        if not self.special_cut or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part)
            for part in self.special_cut.split(text)
            if part
        )

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a text from its ids."""
        tokens = np.frombuffer(ids, "<u4")
        out = []
        for i in range(0, len(tokens), 1 << 18):
            part = tokens[i : i + (1 << 18)]
            begin = self.offsets[part]
            sizes = self.offsets[part + 1] - begin
            ends = np.cumsum(sizes)
            place = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])
            out.append(self.bytes[place].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One codec per worker process and vocabulary."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and ids (binary, little-endian unsigned 32-bit) of every row.

    A null text is encoded as an empty one; null and repeated ids are kept as they are; no rows
    give no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path)
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; counts and digests of both instead of the ids.

    Columns: `id_col`, n_tokens, ids_sha256, decoded_sha256.  Nulls as in `encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = codec.encode(t.as_py() or "")
                text = codec.decode(ids).decode("utf-8", "replace")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)
