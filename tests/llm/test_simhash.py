import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import simhash
from lexloom.llm.components import Forest, components
from tests.llm.conftest import MESSY


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def smallest_reachable(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@given(st.text(alphabet="aB \n\t\x0bé☃.", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) == plain(text)


@pytest.mark.parametrize("radius", range(5))
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(300)], dtype=np.uint64)
    fps = base[rng.integers(0, 40, 300)] ^ flips
    want = {(i, j) for i in range(300) for j in range(300) if int(fps[i] ^ fps[j]).bit_count() <= radius}
    got = {(int(a), int(b)) for i, j in simhash.within(fps, fps, radius) for a, b in zip(i, j, strict=True)}
    assert got == want
    got = {(int(a), int(b)) for i, j in simhash.within(fps, fps, radius, after=True) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i, j in want if j > i}


@pytest.mark.parametrize(("blocks", "tile"), [(5, 1 << 15), (6, 16), (7, 1 << 15), (8, 7)])
def test_no_link_is_lost(spark, monkeypatch, blocks, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(blocks)
    base = rng.integers(-(2**63), 2**63, 6, dtype=np.int64).view(np.uint64)
    fps = {int(b) for b in base}
    for b in list(fps):
        x = b
        for _ in range(25):
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(x)
    own = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    links = [(a, b) for a in own for b in own if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    found = simhash.links(spark.createDataFrame([(x,) for x in own], "fp long"), blocks=blocks)
    got = {r["node"]: r["component"] for r in components(found).collect()}
    want = smallest_reachable(links, own)
    assert {n: got.get(n, n) for n in own} == want


def test_few_pairs_are_spelled_out_at_once(monkeypatch):
    """Of a bucket in which all are close to all, in pieces, every pair once."""
    monkeypatch.setattr(simhash, "SPELLED", 8)
    rng = np.random.default_rng(4)
    fps = np.array([1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 64, (300, 2))], dtype=np.uint64)
    found = list(simhash.within(fps, fps, after=True))
    assert max(len(i) for i, _ in found) <= 8 * 64 and len(found) > 50
    pairs = Counter((int(a), int(b)) for i, j in found for a, b in zip(i, j, strict=True))
    assert set(pairs.values()) == {1} and len(pairs) == 300 * 299 // 2


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**9, 10**11)] == [5, 5, 6, 7]
    assert [len(simhash.masks(b)) for b in (5, 6, 7)] == [5, 15, 35]


def test_messy(spark, messy, nothing):
    got = sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(messy).collect()), key=str)
    fps = [(d, plain(t)) for d, t, *_ in MESSY]
    distinct = sorted({f for _, f in fps})
    comp = smallest_reachable([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4], distinct)
    names = {}
    for d, f in fps:
        if d is not None:
            names[comp[f]] = min(d, names.get(comp[f], d))
    assert got == sorted(((d, f, names.get(comp[f])) for d, f in fps), key=str)
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each_group_stays(messy):
    kept = simhash.deduplicate(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 11, 12, 13, 14]
    assert kept.where("doc_id IS NULL").count() == 2


def test_one_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in ("ab", "cd", "ef"))
    rows = [(None, a, 1), (None, a, 1), (None, a.upper(), 1), (None, b, 2), (7, c, 3), (7, c, 3), (7, b, 2), (8, b, 2), (9, None, 4), (9, c, 3)]
    for part in (rows, rows[::-1]):
        got = simhash.deduplicate(spark.createDataFrame(part, "doc_id long, text string, topic int").repartition(3)).collect()
        assert sorted(((r["doc_id"], r["topic"]) for r in got), key=str) == [(7, 2), (7, 3), (9, 4), (None, 1), (None, 2)]
    # Of a group named by an id that another group shares, one document stays.
    rows = [(1, a), (1, b), (2, a), (3, b)]
    assert sorted(map(tuple, simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, a), (1, b)]


def test_ties_go_by_all_columns(spark):
    """Rows of one id and one text: whatever the split, the same one stays."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, f"source {i}", i) for i in range(8)] + [(2, None, "x", 1), (2, "", "x", 1), (2, "", "w", 1)] + [(None, text, f"lone {i}", i) for i in range(4)]
    found = set()
    for seed in range(4):
        dealt = random.Random(seed).sample(rows, len(rows))
        out = simhash.deduplicate(spark.createDataFrame(dealt, "doc_id long, text string, source string, n int").repartition(1 + seed)).collect()
        found.add(tuple(sorted(map(tuple, out), key=str)))
    assert len(found) == 1 and [r[0] for r in next(iter(found))] == [1, 2, None]


@pytest.mark.parametrize("copies", [3, 400])
def test_rows_equal_in_all_columns_are_one(spark, copies):
    """Few, and so many that they are one in each task first."""
    text, other = (" ".join(f"{w}{i}" for i in range(30)) for w in ("ab", "cd"))
    rows = [(1, text, "s")] * copies + [(None, None, None)] * copies + [(2, text, "s"), (3, other, None)] + [(10 + i, f"{i * 7919} {i * 104729} {i} x{i}", "s") for i in range(40)]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    assert sorted(map(tuple, out), key=str) == sorted({(1, text, "s"), (None, None, None), (3, other, None)} | set(rows[-40:]), key=str)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, x) for x in range(1001, 1400)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2600, (250, 2))] + [(5, 5), (7, 8)]
    want = smallest_reachable(links, {x for e in links for x in e if e[0] != e[1]})
    got = components(spark.createDataFrame(links, "a long, b long").repartition(3))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    f = Forest(6)
    f.link(np.array([5, 3, 5]), np.array([4, 1, 3]))
    assert f.label.tolist() == [0, 1, 2, 1, 1, 1] and sorted(zip(*(x.tolist() for x in f.edges()), strict=True)) == [(3, 1), (4, 1), (5, 1)]
