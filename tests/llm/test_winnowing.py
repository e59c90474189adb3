import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import winnowing as W
from tests.llm.conftest import MESSY


def plain(text, k, window):
    """(hash, position) by definition: the rightmost smallest of each window."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    h = W.gram_hashes(points, k)
    chosen = {}
    for a in range(max(len(h) - window + 1, 1) if len(h) else 0):
        own = h[a : a + window]
        at = a + int(np.flatnonzero(own == own.min())[-1])
        chosen[at] = int(h[at])
    return [(v, p) for p, v in sorted(chosen.items())]


@given(st.text(alphabet="abé☃", max_size=80), st.integers(1, 6), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_by_definition(text, k, window):
    hashes, positions = W.winnow(text, k, window)
    assert list(zip(hashes.tolist(), positions.tolist(), strict=True)) == plain(text, k, window)


def test_hashes_depend_on_the_gram_alone():
    text = "abcdefgh" * 5000 + "x"
    h = W.gram_hashes(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), 8)
    assert len(set(h[:-1].tolist())) == 8 and len(set(h.tolist())) == 9


@given(st.text(alphabet="abcd", min_size=32, max_size=50), st.text(alphabet="abcd", max_size=60), st.text(alphabet="abcd", max_size=60))
@settings(max_examples=80, deadline=None)
def test_match_guarantee(shared, left, right):
    a, b = W.winnow(left + shared, 16, 17), W.winnow(shared + right, 16, 17)
    own = dict(zip(a[0].tolist(), a[1].tolist(), strict=True))
    hits = [(own[h], p) for h, p in zip(b[0].tolist(), b[1].tolist(), strict=True) if h in own]
    assert any((left + shared)[i : i + 16] == (shared + right)[j : j + 16] for i, j in hits)


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_messy(spark, messy, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = W.edits(messy).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Falling ids, repeated ones by text, those without one last.
    order = sorted(((d, t or "") for d, t, *_ in MESSY), key=lambda x: (-(x[0] if x[0] is not None else -1), x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        sets = [set(x for x, _ in plain(y, W.K, W.WINDOW)) if len(y) < 5000 else set(W.winnow(y)[0].tolist()) for y in (t, edited, following)]
        near = [1.0 if not sets[0] and not s else len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), W.digest(*W.winnow(t)), W.digest(*W.winnow(edited)), *near))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == sorted(want, key=str)


def test_small_tables(spark, nothing):
    assert W.edits(nothing).count() == 0
    r = W.edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0


def test_operator(messy):
    rows = {r["doc_id"]: r for r in W.fingerprints(messy.where("doc_id IN (5, 8, 14)")).collect()}
    assert (rows[8]["hashes"], len(rows[14]["hashes"]), rows[14]["positions"]) == ([], 1, [0])
    assert len(rows[5]["hashes"]) == len(rows[5]["positions"])
