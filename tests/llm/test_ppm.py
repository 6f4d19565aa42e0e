"""Scores by prediction by partial matching, against a plain trie."""

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from energylake.llm import ppm

from .conftest import ODD


def plain_trie(texts):
    """Every context of every length, whatever its count."""
    counts = [Counter() for _ in range(ppm.ORDER + 1)]
    for t in texts:
        s = [256] * ppm.ORDER + list((t or "").encode()) + [256]
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts[k][tuple(s[i - k : i + 1])] += 1
    trie = []
    for found in counts:
        nodes = {}
        for g, n in found.items():
            nodes.setdefault(g[:-1], {})[g[-1]] = n
        trie.append(nodes)
    return trie


def plain_probability(trie, context, symbol):
    escape, excluded = 1.0, set()
    for k in range(ppm.ORDER, -1, -1):
        left = {x: n for x, n in trie[k].get(tuple(context[ppm.ORDER - k :]), {}).items() if x not in excluded}
        if left:
            total = sum(left.values()) + len(left)
            if symbol in left:
                return escape * left[symbol] / total
            escape *= len(left) / total
            excluded |= set(left)
    return escape / (257 - len(excluded))


def plain_score(trie, text):
    s = [256] * ppm.ORDER + list((text or "").encode()) + [256]
    return sum(math.log10(plain_probability(trie, s[i - ppm.ORDER : i], s[i])) for i in range(ppm.ORDER, len(s)))


TRAIN = ["abracadabra", "abc", "", None, "banane é", "xyx" * 5, "abrakadabra abrac", "the then there the"] * 2


def code(symbols):
    out = 0
    for x in symbols:
        out = out << ppm.BITS | x
    return out


def test_lengths(spark):
    """All symbols after contexts that were seen, in part or not at all."""
    df = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3)
    model = ppm.Model(df.fillna(""))
    plain = plain_trie(TRAIN)
    contexts = [list(b"abrac"), list(b"zzabr"), list(b"zzzzz"), [256] * 5, [256, 256, *b"the"], list(b" then")]
    wanted = {code([*c, x]): math.log10(plain_probability(plain, c, x)) for c in contexts for x in range(257)}
    rows = spark.createDataFrame([(c,) for c in wanted], "code long")
    got = {r.code: r.length for r in model.lengths(rows).collect()}
    assert got == pytest.approx(wanted, abs=1e-9)
    for c in contexts:
        assert sum(10 ** got[code([*c, x])] for x in range(257)) == pytest.approx(1)


def test_a_context_that_all_symbols_followed(spark):
    """There is nothing to escape to, so nothing is kept back for it."""
    texts = ["".join("ab" + chr(x) for x in range(128)), "abab" * 3]
    symbols = spark.createDataFrame([(code([97, x]), 1 + x % 3) for x in range(257)], "code long, n long")
    whole = ppm.with_contexts(symbols).first()
    assert (whole.kinds, whole.total) == (257, sum(1 + x % 3 for x in range(257)))
    model = ppm.Model(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = plain_trie(texts)
    for c in ([97, 98, 97, 98, 97], [1, 1, 1, 97, 98]):
        rows = spark.createDataFrame([(code([*c, x]),) for x in range(257)], "code long")
        got = {r.code & 511: r.length for r in model.lengths(rows).collect()}
        assert got == pytest.approx({x: math.log10(plain_probability(plain, c, x)) for x in range(257)}, abs=1e-9)


@pytest.mark.parametrize("hot", [0, 20, 1 << 22])
def test_scores_do_not_depend_on_what_the_workers_hold(odd, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT", hot)
    compare(odd, ODD)


def test_every_context_counts(spark, monkeypatch):
    """More contexts than the workers hold, most of them seen once: none is passed over."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefghij ") for _ in range(300))) for i in range(60)]
    monkeypatch.setattr(ppm, "HOT", 100)
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_streams_cut_nothing(monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK", 7)
    texts = ["", "abc", None, "a longer text", "é", "", "x"]
    seen = []
    for stream, first, last in ppm.symbol_stream(pa.array(texts)):
        for a, b in zip(first, last, strict=True):
            assert (stream[a - ppm.ORDER : a] == ppm.MARK).all() and stream[b - 1] == ppm.MARK
            seen.append(bytes(stream[a : b - 1].astype("u1")).decode())
    assert seen == [t or "" for t in texts]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def expected(rows):
    counts, docs = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            docs += 1
    n, v = sum(counts.values()) + docs, len(counts) + (docs > 0)
    counts[None] = docs
    trie = plain_trie([t for i, t in rows if not held(i)])
    out = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), n, base, plain_score(trie, t)))
    return sorted(out, key=str)


def compare(df, rows):
    got = sorted(map(tuple, ppm.score(df, held_out()).collect()), key=str)
    for g, w in zip(got, expected(rows), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-3)


def test_all_but_the_most_frequent_words_are_looked_up(odd, monkeypatch):
    monkeypatch.setattr(ppm.frequent_words, "__defaults__", (4,))
    compare(odd, ODD)


def test_no_rows_and_no_training_rows(odd, empty):
    assert ppm.score(empty, held_out()).collect() == []
    rows = ppm.score(odd.filter("doc_id = 2"), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(1, 0, 0)]
    assert rows[0].score == pytest.approx(-math.log10(257), abs=1e-4)
    assert rows[0].base_score == 0


def test_model_beats_a_uniform_one_on_held_out_texts(documents, texts):
    rows = [r for r in ppm.score(documents, held_out()).collect() if r.held_out]
    bytes_ = sum(len(texts[r.doc_id].encode()) + 1 for r in rows)
    assert sum(r.score for r in rows) / bytes_ > 0.5 * -math.log10(257)
