"""Minimum-bin-slack packing."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from energylake.llm import packing
from energylake.llm.shards import best_fit_decreasing

from .conftest import ODD
from .test_binary import ids_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_fullest(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
    room = rng.randint(1, 120)
    chosen = packing.fullest(counts, room)
    assert all(n <= counts[x] for x, n in chosen)
    sums = (
        sum(x * n for x, n in zip(counts, times, strict=True))
        for times in product(*[range(n + 1) for n in counts.values()])
    )
    assert sum(x * n for x, n in chosen) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("seed", range(5))
def test_plan_takes_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice([1, 64, 100, rng.randint(1, 100)]) for _ in range(3000))
    bins = packing.plan(histogram, 100)
    taken = Counter()
    for combination, repeat in bins:
        assert sum(x * n for x, n in combination) <= 100
        for x, n in combination:
            taken[x] += n * repeat
    assert taken == histogram
    assert sum(r for _, r in bins) <= max(best_fit_decreasing(list(histogram.elements()), 100)) + 1


def check(rows, texts, capacity):
    """Pieces of every document, and sequences without gaps."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in texts:
        ids = ids_of(t, end=1)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[i].append((k, at, len(part), zlib.crc32(part.tobytes())))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    return places


def test_odd_rows(odd):
    check(packing.pack(odd, PATH, capacity=64).collect(), ODD, 64)


def test_no_rows(empty):
    assert packing.pack(empty, PATH).collect() == []


def test_few_sequences(documents, texts):
    rows = packing.pack(documents, PATH).collect()
    places = check(rows, texts.items(), 4096)
    tokens = sum(r.length for r in rows)
    assert len(places) <= -(-tokens // 4096) + 1


def test_hot_length(spark):
    rows = [(i, "same text" if i % 3 == 0 else "word " * (i % 17)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(packing.pack(df, PATH, capacity=32).collect(), rows, 32)


def test_sequences_hold_the_ids(documents, texts):
    packed = packing.pack(documents, PATH, with_ids=True).cache()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = ids_of(texts[r.doc_id], end=1)[r.start : r.start + r.length]
        assert whole[r.sequence_id][r.offset : r.offset + r.length].tolist() == own
    packed.unpersist()
