"""SimHash fingerprints, links and groups against brute force."""

import re

import numpy as np
import pytest
import xxhash

from energylake.llm import simhash
from energylake.llm.components import components

from .conftest import ODD


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(fps, max_bits):
    """Smallest member of each fingerprint's component."""
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= max_bits:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {f: top(f) for f in fps}


@pytest.mark.parametrize(
    "text", ["", None, "a", "A b", "a b c d", "É a B c d\x85e f", "x " * 500, "a\x1cb c\xa0d e", *[t for _, t in ODD]]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near(rng, n, spread):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = [base]
    for k in range(1, spread + 1):
        x = base.copy()
        for _ in range(k):
            x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4, 5, 8])
def test_linked_fingerprints_meet_in_a_cell(max_bits):
    fps = near(np.random.default_rng(max_bits), 60, 9)
    cells = {}
    for part, cell, owner in simhash.cells_of(fps, max_bits):
        for c, f in zip(cell.tolist(), owner.tolist(), strict=True):
            cells.setdefault((part, c), set()).add(f)
    met = {
        (a, b) for m in cells.values() for a in m for b in m if a < b and (a ^ b).bit_count() <= max_bits
    }
    every = fps.tolist()
    assert met == {(a, b) for a in every for b in every if a < b and (a ^ b).bit_count() <= max_bits}


def signed(fps):
    return fps.astype(np.int64).tolist()


@pytest.mark.parametrize("block", [8192, 16, 3])
def test_groups_with_cells_cut_into_blocks(spark, block):
    rng = np.random.default_rng(7)
    # one dense cluster around a fingerprint, and scattered ones
    dense = np.unique(np.array([12345 ^ (1 << a) ^ (1 << b) for a in range(14) for b in range(a)], np.uint64))
    fps = np.unique(np.concatenate([dense, near(rng, 30, 6)]))
    df = spark.createDataFrame([(f,) for f in signed(fps)], "fp long").repartition(3)
    links = simhash.link_forest(df, 4, block)
    rows = {r.node: r.root for r in components(links).collect()}
    got = [rows.get(f, f) for f in signed(fps)]
    want = groups_of(fps.tolist(), 4)
    same = {}
    for f, g in zip(fps.tolist(), got, strict=True):
        assert same.setdefault(g, want[f]) == want[f]
    assert len(same) == len(set(want.values()))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (3, 4)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components(df.limit(0)).collect() == []


def component_ids(rows):
    fps = {simhash.fingerprint(t) for _, t in rows}
    root = groups_of(sorted(fps), 4)
    least = {}
    for i, t in rows:
        if i is not None:
            g = root[simhash.fingerprint(t)]
            least[g] = min(i, least.get(g, i))
    return [(i, f"{simhash.fingerprint(t):016x}", least.get(root[simhash.fingerprint(t)])) for i, t in rows]


def test_odd_rows(odd):
    got = simhash.groups(odd).select("id", simhash.hex_fingerprint("fp"), "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, component_ids(ODD)))


def test_table(documents, texts):
    got = simhash.groups(documents).select("id", simhash.hex_fingerprint("fp"), "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(component_ids(list(texts.items())))


def test_no_rows(empty):
    assert simhash.groups(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


def test_one_of_each_group_stays(odd):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    # blank texts are one group; of the repeated row one stays; all else is different
    want = [r for r in ODD if r[0] not in (2, 3, 5, 6)] + [ODD[5]]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_groups_without_any_id_stay_apart(spark):
    rows = [(None, "one text of several words"), (None, "quite another text with words"), (1, "third")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.keep_one(df).count() == 3
