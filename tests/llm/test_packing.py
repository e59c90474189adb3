import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import packing
from lexloom.llm.tokens import ByteBpe, default_vocabulary
from tests.llm.conftest import MESSY

WHOLE = Tokenizer.from_file(default_vocabulary())


def plain(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@given(st.text(alphabet=st.sampled_from(list("ab 's1\n\t é☃.,")) | st.characters(exclude_categories=["Cs"]), max_size=40))
@settings(max_examples=200, deadline=None)
def test_ids(text):
    assert BPE.ids(text) == plain(text).tobytes()


BPE = ByteBpe(cache_words=50)


def test_special_text():
    assert BPE.ids("a <|endoftext|> b") == plain("a <|endoftext|> b").tobytes()


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17, 100])
def test_cuts(n):
    own = packing.cuts(n, 8)
    assert [a for a, _ in own] == np.cumsum([0] + [x for _, x in own])[:-1].tolist() and sum(x for _, x in own) == n
    assert all(x == 8 for _, x in own[1:])


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan(counts):
    sequences = packing.plan(counts, 64)
    used = defaultdict(int)
    for lengths, n in sequences:
        assert sum(lengths) <= 64 and n > 0
        for length in lengths:
            used[length] += n
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    best = sum(n for _, n in packing.best_fit(counts, 64))
    assert -(-total // 64) <= sum(n for _, n in sequences) <= best * 1.1 + 2


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths, n = np.unique(np.clip(rng.lognormal(6.2, 0.9, 50_000).astype(int), 1, 2048), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    sequences = packing.plan(counts)
    bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(n for _, n in sequences) <= bound * 1.002 + 1
    assert sum(n for lengths, n in sequences if len(lengths) > 1 and sum(lengths) == 2048) > 0.5 * bound


def test_least_squares():
    columns = np.array([[0, 3, 5], [2, 3, 3], [2, 2, 4], [0, 4, 4]])
    counts = np.zeros(9)
    counts[[2, 3, 4, 5]] = [10, 30, 0, 20]
    chosen, x = packing.non_negative_least_squares(columns, counts)
    residual = counts - np.bincount(chosen.ravel(), weights=np.repeat(x, 3), minlength=9)
    residual[0] = 0
    # The optimum's conditions: no gradient on active columns, none to gain from the others.
    assert (x >= 0).all() and np.abs(residual[chosen].sum(1)[x > 0]).max() < 1e-2
    assert residual[columns].sum(1).max() <= 1


@pytest.mark.parametrize("capacity", [8, 2048])
def test_messy(messy, nothing, capacity):
    rows = packing.pack(messy, capacity, with_ids=True).collect()
    want = []
    for d, t, *_ in MESSY:
        ids = np.append(plain(t), 0).astype("<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        bounds = [0, first, *range(first + capacity, len(ids) + 1, capacity)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(nothing).count() == 0


def test_sequences(messy):
    packed = packing.pack(messy, 64, with_ids=True)
    rows = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        at = 4 * r["offset"]
        assert rows[r["sequence_id"]][at : at + 4 * r["length"]] == bytes(r["ids"])


def test_other_vocabularies(spark):
    """Another JSON vocabulary, of another kind, gives the ids that its own library gives."""
    import public_tokenizers

    from lexloom.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, bpe = Tokenizer.from_file(path), tokens.ByteBpe(path)
    for text in ("The quick  brown fox", "", " \n x", "Ünïcödé ☃ <|endoftext|> y"):
        assert bpe.ids(text) == np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    docs = spark.createDataFrame([(1, "a fox and a fox"), (2, None)], "doc_id long, text string")
    assert packing.pack(docs, 8, path).agg(F.sum("length")).first()[0] == len(whole.encode("a fox and a fox", add_special_tokens=False).ids) + 2


def test_ranks_come_from_the_file(tmp_path):
    import json

    import public_tokenizers

    from lexloom.llm import tokens

    own = tmp_path / "own.json"
    content = json.loads(open(tokens.default_vocabulary(), encoding="utf-8").read())
    own.write_text(json.dumps(content), encoding="utf-8")
    text = "It's 3.14 Ünïcödé ☃ words"
    assert tokens.ByteBpe(str(own)).ids(text) == tokens.ByteBpe().ids(text) and public_tokenizers.PATTERN == tokens.PATTERN
    content["model"]["merges"][:2] = content["model"]["merges"][1::-1]  # merges out of the order of ids
    assert tokens.ranks_of(content) is None


def test_query(spark):

    from lexloom.llm.packing import op3_best_fit_packing

    out = op3_best_fit_packing(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    ends = defaultdict(list)
    for r in out.collect():
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
