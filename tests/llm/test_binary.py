"""Token files with Elias-Fano boundaries."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from energylake.llm import binary
from energylake.session import new_path

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text, end=2):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=700))
def test_sequence_round_trip(values):
    values = np.sort(np.array(values, np.int64))
    code = binary.EliasFano.of(values)
    back, size = binary.EliasFano.from_bytes(memoryview(code.to_bytes()))
    assert size == len(code.to_bytes())
    assert (back.values() == values).all()
    assert [back[i] for i in range(len(values))] == values.tolist()
    for first, count in [(0, 3), (len(values) // 2, 300), (255, 2), (256, 256), (257, 9), (len(values), 5)]:
        assert back.select(first, count).tolist() == values[first : first + count].tolist()


def test_sequence_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    size = len(binary.EliasFano.of(ends).to_bytes()) * 8 / len(ends)
    assert size < 2.5 + np.log2(1000) + 1


def test_file_by_place():
    docs = [None, None, -5, 0, 0, 10**12]
    tokens = [[1], [], [70000, 2], [3], [], [4, 5, 6]]
    data = binary.to_file(docs, [np.array(t, "<u4").tobytes() for t in tokens])
    file = binary.TokenFile(data)
    assert [file.doc_id(i) for i in range(6)] == docs
    assert [file.ids(i).tolist() for i in range(6)] == tokens
    assert file.width == 4
    for first in range(6):
        for count in range(1, 7 - first):
            assert file.slice_ids(first, count).to_pylist() == docs[first : first + count]
            bounds = file.slice_bounds(first, count)
            assert list(zip(bounds[:-1], bounds[1:])) == [file.bounds(i) for i in range(first, first + count)]


def test_only_the_bytes_of_a_slice_are_read():
    values = np.cumsum(np.random.default_rng(1).integers(0, 900, 50_000))
    code = binary.EliasFano.of(values)
    whole = code.high
    # everything but the neighbourhood of the slice is wiped out
    lo, hi = int(code.samples[39_000 // binary.SAMPLE]) >> 3, int(code.samples[40_000 // binary.SAMPLE + 2]) >> 3
    code.high = np.concatenate([np.zeros(lo, np.uint8), whole[lo:hi], np.zeros(len(whole) - hi, np.uint8)])
    assert (code.select(39_100, 900) == values[39_100:40_000]).all()


def test_not_a_file():
    with pytest.raises(ValueError, match="token file"):
        binary.TokenFile(b"x" * 100)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for i, t in rows]


def test_odd_rows(odd):
    got = binary.round_trip(odd, PATH).orderBy("start").collect()
    assert got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert [r.doc_id for r in got] == [i for i, *_ in expected(ODD)]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(expected(ODD), key=key)


def test_no_rows(empty):
    assert binary.round_trip(empty, PATH).collect() == []


def test_many_files_in_order(documents, texts, spark, monkeypatch):
    # workers import the module anew, so the bound goes through the module they see
    folder = new_path(spark, "store")
    files = binary.write_tokens(documents, PATH, folder)
    listed = files.orderBy("part", "seq").collect()
    assert [f.first for f in listed] == list(np.cumsum([0, *[f.n_tokens for f in listed]])[:-1])
    got = binary.read_tokens(files).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == expected(texts.items())
