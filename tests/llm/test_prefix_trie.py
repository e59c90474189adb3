import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexloom.llm import prefix_trie as P
from lexloom.operators import running

SCHEMA = "conv_id long, turn long, role string, text string, depth string, label string, n string, x string"


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def plain(rows):
    """The nodes by the definition, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    members, total = defaultdict(list), {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        total[c] = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(total[c]) + 1):
            members[total[c][:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own_members in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(own_members) - 1) * words
    out = []
    for k, own_members in members.items():
        end = ",".join(map(str, sorted(c for c in own_members if total[c] == k)))
        out.append((min(own_members), len(k), min(members[k[:-1]]) if k else None, len(own_members), children[k], leaves[k], saved[k], hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    out = P.trie(P.prefixes(P.rebuilt(df)))
    assert dict(out.dtypes) == {**dict.fromkeys(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "bigint"), "ends_sha256": "string"}
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == plain(rows)
    return got


def test_messy(spark):
    rows = [(c, t, r, x) for c in (0, 1, 2, 3, 5, 20, 21, 41, 19, -3, -20) for t, (r, x) in enumerate([("user", "hi there"), ("bot", None), (None, "a b\tc"), ("user", f"{c % 3} x"), ("bot", "bye")][: 1 + c % 6])]
    rows += [(7, None, "user", "null turn"), (7, None, None, None), (7, 2, "user", "twice"), (7, 2, "user", "twice"), (7, 2, "bot", "tie"), (None, 0, "user", "no id"), (None, 1, "user", "no id")]
    rows += [(60, 0, "us", "er"), (61, 0, "use", "r"), (62, 0, "", "user"), (63, 0, None, "user"), (64, 0, "a", "")]
    check(spark, rows)
    # A conversation whose few turns all go, and whose group's first is absent.
    lone = next(c for c in range(101, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    assert check(spark, [(lone, 0, "user", "gone"), (lone, 1, "user", "gone")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_empty(spark):
    assert P.trie(P.prefixes(P.rebuilt(spark.createDataFrame([], SCHEMA)))).collect() == []


def chains():
    """Conversations that are prefixes of one another, a hot one with very many copies, and a long one that none shares."""
    rows = []
    for k in range(1, 41):
        c = 20 * k  # takes its own head
        rows += [(c, t, "user", f"turn {t}") for t in range(k)]
    rows += [(20 * k, t, "user", f"copy {t}") for k in range(100, 180) for t in range(3)]
    rows += [(4000, t, "user", f"long {t}") for t in range(150)]
    return rows


@pytest.mark.parametrize("few", [16, 1024])
def test_chains(spark, monkeypatch, few):
    monkeypatch.setattr(running.running, "__defaults__", (few,))
    got = check(spark, chains())
    assert max(r[1] for r in got) == 150


def test_rounds_follow_the_branching(spark, monkeypatch):
    rounds = []
    staged = P.staged
    monkeypatch.setattr(P, "staged", lambda df, name: (rounds.append(name), staged(df, name))[1])
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in chains()], SCHEMA)
    P.trie(P.prefixes(P.rebuilt(df)))
    assert rounds.count("waiting") <= 16  # of 150 levels


def test_random(spark):
    random.seed(4)
    rows = [(c, t, random.choice(["user", "bot"]), random.choice(["a", "b c", ""])) for c in random.sample(range(400), 150) for t in range(random.randrange(1, 7))]
    check(spark, rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted(map(tuple, P.op12_prefix_trie(spark, sf).collect()), key=str) == plain(rows)
