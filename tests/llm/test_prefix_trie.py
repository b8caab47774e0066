from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pawnmill.llm import prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(set)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        s = rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    inner = {p[:-1] for p in members if p}
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in inner
            saved[p[:d]] += (len(m) - 1) * words(p)
        if p:
            children[p[:-1]] += 1
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if rebuilt[c] == p))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, TURNS)
    out = prefix_trie.prefix_trie(df, **more).collect()
    places = sorted((r["first_pos"], r["last_pos"]) for r in out)
    assert [a for a, _ in places] == list(range(len(out)))
    for r in out:  # a node's interval holds its subtree, and intervals nest
        assert r["first_pos"] <= r["last_pos"] and (r["n_children"] == 0) == (r["first_pos"] == r["last_pos"])
    return sorted((tuple(r[c] for c in OUT) for r in out), key=repr)


ODD = [
    (0, 0, "user", "a b  c"), (0, 1, "bot", "x"), (0, 1, "bot", "x"), (0, None, None, None), (0, None, "user", "first"), (1, 5, "user", "own"), (1, 6, "", "\t\n"), (2, 0, "user", "only"), (-3, 0, "user", "neg"),
    (-3, 1, "user", None), (41, 0, "r", "no base"), (41, 1, "r", "two"), (45, 0, "r", "no base"), (None, 0, "user", "lost"), (7, 0, "ab", "c"), (8, 0, "a", "bc"), (19, 3, "user", "Ünï 😀"), (20, 0, "user", "a b  c"), (2**62, 0, "user", "long " * 5000),
]


@pytest.mark.parametrize("block", [2, 32])
def test_awkward_turns(spark, block):
    assert found(spark, ODD, block=block) == brute(ODD)


@pytest.mark.parametrize("block", [2, 3])
def test_deep_and_shared_conversations(spark, block):
    """Paths of several levels of blocks, and conversations that part at every depth."""
    rng, rows = random.Random(5), []
    long = [("user", f"w{rng.randrange(3)}") for _ in range(40)]
    for c in range(60):
        turns = long[: rng.randrange(41)] + [("bot", f"t{rng.randrange(2)}") for _ in range(rng.randrange(4))]
        rows += [(c * (1 if c % 3 else 20), k, *t) for k, t in enumerate(turns)]
    rows += [(100_000 + 20 * c, k, "user", f"s{k}") for c in range(50) for k in range(3)]  # one conversation many times
    assert found(spark, rows, block=block) == brute(rows)


def test_empty_and_null_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in ODD], TURNS + ", id int, path int, depth int, `a.b` int")
    out = prefix_trie.prefix_trie(df).collect()
    assert sorted((tuple(r[c] for c in OUT) for r in out), key=repr) == brute(ODD)


def test_ids_of_many_members_are_digested_in_pieces(spark):
    rows = [(20 * c, 0, "user", "same") for c in range(500)]
    df = spark.createDataFrame(rows, TURNS)
    ends = df.selectExpr("conv_id AS id", "1L AS depth", "5L AS x1", "6L AS x2")
    (r,) = prefix_trie.digests_of_ends(ends, chunk=7).collect()
    assert r["ends_sha256"] == hashlib.sha256(",".join(str(20 * c) for c in range(500)).encode()).hexdigest()


def test_a_hot_conversation_is_numbered_by_ranges(spark):
    rows = [(1, k // 2, "u", "same") for k in range(3000)] + [(2, 0, "u", "x")]
    nth = prefix_trie.number_turns(spark.createDataFrame(rows, TURNS)).where("id = 1").select("nth").collect()
    assert sorted(r["nth"] for r in nth) == list(range(3000))
