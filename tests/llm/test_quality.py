"""Quality rules against plain Python."""

import re
from collections import Counter

import pytest

from energylake.llm import quality

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), n < 20 or 100 * len(covered) > 30 * n,
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def counted(df):
    return sorted(
        str((r.row.doc_id, *[r[c] for c in COUNTS])) for r in quality.quality(df).collect()
    )


def test_odd_rows(odd):
    assert counted(odd) == sorted(str((i, *plain(t))) for i, t in ODD)


def test_table(documents, texts):
    assert counted(documents) == sorted(str((i, *plain(t))) for i, t in texts.items())


TEXTS = [
    "a b c d e f g h " * 2,
    "a b c d e f g h i a b c d e f g h",
    "x " * 8,
    "x " * 9,
    "x " * 30,
    "a b c d e f g h i j k l m n o p q r s t " * 2 + "end",
    "same line here\nsame line here\n\n \nother\nsame line here",
    "tab\tvt\x0bff\x0ccr\rnbsp\xa0nel\x85end",
    "\n\n\n",
    "dangling # * $ % & | < > symbols" * 3,
]


def test_repeats_and_lines(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert counted(df) == sorted(str((i, *plain(t))) for i, t in enumerate(TEXTS))


GOOD = "the quick brown fox jumps over a lazy dog and runs to the river in search of water, that is all it wants today"


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        (GOOD, True),
        ("zz " * 19, False),
        (" ".join(w + "###" for w in GOOD.split()), False),
        (" ".join(chr(97 + i % 26) for i in range(40)), False),
        (" ".join(f"word{i}" for i in range(50)), True),
        (" ".join(f"word{i}" for i in range(150)), False),
        (" ".join(f"w{i // 5}" for i in range(100)) + " the of", False),
        ("\n".join([GOOD] + ["menu item"] * 4), False),
    ],
)
def test_verdict(spark, text, kept):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.quality(df).first().kept is kept
    assert quality.keep_good(df).count() == int(kept)


def test_kept_rows_are_unchanged(odd):
    got = quality.keep_good(odd)
    assert got.columns == odd.columns
    assert {r.doc_id for r in got.collect()} <= {i for i, _ in ODD}


def test_no_rows(empty):
    assert quality.quality(empty).collect() == []


def test_one_projection_without_python(odd):
    plan = quality.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
