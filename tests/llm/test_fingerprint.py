from __future__ import annotations

import hashlib

from pawnmill.llm import fingerprint as F
from tests.llm.helpers import docs, prose


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), F.digest(t), F.digest(edited), float(F.canonical(t) == F.canonical(edited)), float(F.canonical(t) == F.canonical(other)))
    return out


def test_against_brute_force(spark):
    rows = [(3 * k, prose(1 + k % 30, k // 4)) for k in range(200)] + [(1, None), (2, ""), (4, "Ünï😀côde ﬁ"), (5, "same"), (7, " SAME "), (8, "x")]
    found = F.edited_fingerprints(docs(spark, [(*r, "s", 0) for r in rows], ", fingerprint int")).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in found} == brute(rows) and len(found) == len(rows)
    same = [r for r in found if r["doc_id"] in (5, 7)]
    assert len({r["fingerprint"] for r in same}) == 1 and all(r["group_id"] == 5 and r["group_size"] == 2 for r in same)


def test_one_and_no_document(spark):
    r = F.edited_fingerprints(docs(spark, [(1, "abcd")])).collect()
    assert [tuple(x)[1:7] for x in r] == [brute([(1, "abcd")])[1]]
    assert F.edited_fingerprints(docs(spark, [])).count() == 0
    assert F.edited_fingerprints(docs(spark, [(1, "ab"), (1, "ab"), (None, "cd"), (2, "x")])).count() == 4


def test_a_table_from_a_join(spark):
    """Coalesced shuffles, repeated ids with other texts, null ids: nothing hangs on the input's partitions."""
    rows = [(k % 60, prose(1 + k % 9, k)) for k in range(120)] + [(None, prose(3, k)) for k in range(5)]
    left, right = docs(spark, rows), spark.range(60).withColumnRenamed("id", "doc_id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        found = F.edited_fingerprints(left.join(right, "doc_id", "left")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    assert len(found) == len(rows)
    for r in found:
        assert r["fingerprint"] in {F.digest(t) for t in texts[r["doc_id"]]}
    # every document but the greatest is some document's successor
    edits = {r["edited_sha256"] for r in found}
    possible = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for i, ts in texts.items() for a in ts for j, us in texts.items() if i == j or j is None or i is None or i - j == 1 for b in us}
    last = [t for t in texts[None]]
    possible |= {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a in last for b in texts[59]}
    assert edits <= possible


def test_canonical_form():
    assert F.canonical("  Straße  ＡＢ\n") == F.canonical("STRASSE ab") == b"strasse ab"


def test_collided_digests_are_told_apart(spark, monkeypatch):
    rows = docs(spark, [(1, "aa"), (2, "bb"), (3, "aa")])
    assert F.fingerprint_groups(rows)[1] == []
    d = F.digest("aa")
    apart = frozenset([d])
    assert F.digest("aa", apart) != d and F.digest("aa", apart).startswith(d) and F.digest("bb", apart) == F.digest("bb")
    prints = F.fingerprint_texts(rows).replace(F.digest("bb"), d, "digest")
    assert F.shared_slots(prints).any()
