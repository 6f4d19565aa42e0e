"""Exact BPE against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from energylake.llm import bpe

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "a", "  leading and trailing  ", "tabs\t\tand\r\nlines\n\n\n", "don't we'll I'm",
        "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext|", "aaaaaaaaaaaaaaaaaaaaaaa",
        "#" * 3000, "=" * 777, "0123456789" * 50, "漢字かな交じり文 🙂🙃", "ééé́‍", "\x00\x01\xa0 ",
        "ñandú über straße", "abababababababab" * 40, "http://www.example.org/a?b=c&d=e_f",
    ],
)
def test_same_ids_and_back(text):
    codec = bpe.byte_bpe(PATH)
    ids = codec.encode(text)
    assert ids == ids_of(text).tobytes()
    assert codec.decode(ids).decode() == LIBRARY.decode(ids_of(text).tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert bpe.byte_bpe(PATH).encode(text) == ids_of(text).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorst -'", max_size=60))
def test_pieces_that_merge_in_many_ways(text):
    assert bpe.byte_bpe(PATH).encode(text) == ids_of(text).tobytes()


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    codec = bpe.ByteBpe(PATH)
    for text in ("one two three four five", "six seven one two", "eight nine ten"):
        assert codec.encode(text) == ids_of(text).tobytes()


def test_digest_of_odd_rows(odd):
    got = sorted(
        (str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(odd, PATH).collect()
    )
    want = []
    for i, t in ODD:
        ids = ids_of(t)
        back = LIBRARY.decode(ids.tolist(), skip_special_tokens=False)
        want.append(
            (str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        )
    assert got == sorted(want)


def test_encode_keeps_ids(odd):
    got = sorted((str(r.doc_id), bytes(r.ids)) for r in bpe.encode(odd, PATH).collect())
    assert got == sorted((str(i), ids_of(t).tobytes()) for i, t in ODD)


def test_no_rows(empty):
    assert bpe.digest(empty, PATH).collect() == []


def test_table(documents, texts):
    for r in bpe.digest(documents, PATH).collect():
        ids = ids_of(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
