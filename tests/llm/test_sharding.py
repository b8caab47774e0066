from __future__ import annotations

import struct
import zlib
from collections import Counter

import xxhash

from pawnmill.llm import sharding as S
from tests.llm.helpers import docs


def draw(value, *path):
    """Uniform over (0, 1] for a row and a node's path (level, then numbers)."""
    h = 42 if value is None else xxhash.xxh64(struct.pack("<q", value), seed=42).intdigest()
    h = xxhash.xxh64(path[0].encode(), seed=h).intdigest()
    for k in path[1:]:
        h = xxhash.xxh64(struct.pack("<i", k), seed=h).intdigest()
    return ((h >> 11) + 1) / 2**53


def descend(value, tree):
    """The shard of a row, by the rule, without arrays of totals; as long as the leaves joined one by one."""

    def weight(node):
        return node.weight if isinstance(node, S.Leaf) else sum(map(weight, node))

    level, node, path, before, since = 0, tree, (), 0.0, 0.0
    while not isinstance(node, S.Leaf):
        name, at, found, moment = ("region", "rack", "shard")[level], before, None, since
        for k, child in enumerate(node):
            start, end = at, at + weight(child)
            if found is None or start < since:  # being filled, or filled before, when the row came
                found, begin = k, start
            elif (u := draw(value, name, *path, k)) >= start / end:
                found, begin, moment = k, start, start / u
            at = end
        node, path, before, since, level = node[found], (*path, found), begin, moment, level + 1
    return node.shard


def test_against_brute_force(spark):
    rows = [(i, "t" * (i % 50)) for i in range(600)] + [(7000, None), (7001, "é"), (None, "x"), (5, "again")]
    found = S.shard_documents(docs(spark, [(*r, "s", 0) for r in rows], ", shard int")).collect()
    tree = S.standard_tree(8)
    for r in found:
        assert r["shard"] == descend(r["doc_id"], tree)
        assert r["grown_shard"] in (r["shard"], 8) and r["grown_shard"] == descend(r["doc_id"], S.grow(tree))
    texts = {i: t for i, t in rows if i != 5}
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in found if r["doc_id"] in texts)
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len(found) == len(rows) and any(r["grown_shard"] == 8 for r in found)


def test_law_key_at_every_count(spark):
    """What grown_shard says of one more shard is what that count gives; rows move to the new shard alone."""
    rows = docs(spark, [(k, "t", "s") for k in range(3000)])
    before = None
    for n in range(1, 21):
        if n > 9 and n % 3:  # each grown count is compared with the standard tree of that count below
            assert S.grow(S.standard_tree(n)) == S.standard_tree(n + 1)
            before = None
            continue
        found = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in S.shard_documents(rows, n).collect()}
        if before is not None:
            assert all(found[k][0] == before[k][1] for k in found)
        assert all(g in (s, n) for s, g in found.values()) and any(g == n for _, g in found.values())
        before = found


def test_equal_rows_get_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(S, "SPREAD", 7)
    rows = [(None, None)] * 40 + [(3, "x")] * 9 + [(k, "y") for k in range(20)]
    found = S.shard_documents(docs(spark, [(*r, "s", 1, 2) for r in rows], ", slot int, bucket int"), 2).collect()
    assert len(found) == len(rows)
    for shard in (0, 1):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def both(spark, before, after, n=20_000):
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    return [(r["shard"], r["after"]) for r in S.assign_shards(S.assign_shards(rows, before), after, out="after").collect()]


def test_weights(spark):
    tree = ((tuple(S.Leaf(k, w) for k, w in ((0, 1.0), (1, 3.0))),), (tuple(S.Leaf(k, w) for k, w in ((2, 0.5), (3, 1.5))), (S.Leaf(4, 2.0),)))
    n = Counter(a for a, _ in both(spark, tree, tree))
    assert all(abs(n[s] / 20_000 - w) < 0.015 for s, w in {0: 1 / 8, 1: 3 / 8, 2: 1 / 16, 3: 3 / 16, 4: 1 / 4}.items())


def test_movement_is_confined(spark):
    tree = S.standard_tree(13, 2, 3)
    # weight shifted inside a rack: nothing outside it moves; inside a region: nothing outside that
    for weights, inside in (({6: 0.25, 8: 1.75}, {6, 7, 8}), ({0: 0.5, 4: 1.5}, {0, 1, 2, 3, 4, 5})):
        moved = {(a, b) for a, b in both(spark, tree, S.reweigh(tree, weights)) if a != b}
        assert moved and all(a in inside and b in inside for a, b in moved)
    # weight that joins takes rows to its own shard alone
    pairs = both(spark, tree, S.raise_weight(tree, 2, 1.0))
    assert all(b == 2 for a, b in pairs if a != b) and abs(sum(b == 2 for _, b in pairs) / 20_000 - 2 / 14) < 0.015
    assert all(b == 13 for a, b in both(spark, tree, S.grow(tree, 2, 3)) if a != b)


def test_the_shape_of_the_tree_decides(spark):
    shapes = [S.standard_tree(8), S.standard_tree(8, 1, 1), S.standard_tree(8, 1, 8), S.standard_tree(8, 4, 2)]
    for one in shapes[1:]:
        assert sum(a != b for a, b in both(spark, shapes[0], one, 2000)) > 500


def test_draws_grow_with_depth_not_with_shards(spark):
    """A plan for 600 shards has no more draws than one for 8."""
    plans = [S.assign_shards(spark.range(1).withColumnRenamed("id", "doc_id"), S.standard_tree(n, 8, 8))._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") for n in (8, 600)]
    assert plans[1] <= plans[0]


def test_tree_sizes():
    for n in (1, 3, 5, 8, 9):
        assert [x.shard for x in S.leaves(S.standard_tree(n))] == list(range(n))


def test_empty(spark):
    assert S.shard_documents(docs(spark, [])).count() == 0
