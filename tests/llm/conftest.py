"""Small tables with every kind of odd row."""

from __future__ import annotations

import random

import pytest

_random = random.Random(1)
LONG = " ".join(_random.choice(["stone", "river", "a", "the", "moon,"]) for _ in range(9000))
#: id, text; ids and texts repeat, both can be null
ODD = [
    (None, "a row without id, but with a few words of text in it"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "The same row twice.\nIt has two lines and é, 漢字 and 🙂."),
    (5, "The same row twice.\nIt has two lines and é, 漢字 and 🙂."),
    (6, "The same row twice.\nIt has two lines and é, 漢字 and 🙂."),
    (7, "one"),
    (7, "another text of the id"),
    (8, "x" * 5000),
    (9, "<|endoftext|> don't 12345 ... <|startoftext|>"),
    (10, "mail a.b@c.example.org from 10.0.0.1, call +1 (988) 555-2485, pay 4111 1111 1111 1111"),
]
#: names that operators use inside
CLASHING = (
    "id row text_crc32 size code fp part cell words spans clean kept n_words ids length "
    "row_no rank shard slot group held_out score first times own_id own_code"
).split()


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns of clashing names beside them, null in some rows."""
    rows = [(i, t, *[None if k % 2 else k] * len(CLASHING)) for k, (i, t) in enumerate(ODD)]
    schema = "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
