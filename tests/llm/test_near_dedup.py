from __future__ import annotations

import os
import random
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pytest

from pawnmill.llm import bag_minhash as B
from pawnmill.llm import common
from pawnmill.llm import near_dedup as N
from pawnmill.llm.components import components
from pawnmill.llm.shingles import overlap, shingle_bag
from tests.llm.helpers import docs, prose, words


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, threshold=0.8):
    bags, root = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            union = sum((bags[a] | bags[b]).values())
            if (sum((bags[a] & bags[b]).values()) / union if union else 1.0) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    rng, rows = random.Random(2), []
    base = words(150, 1)
    for k in range(60):  # copies with none to four edits: links near the threshold, chains
        w = base[:]
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(words(20 + 9 * k, 50 + k))) for k in range(30)]
    rows += [(200 + k, " ".join(words(20 + 9 * k, 50 + k)).upper() + "  ") for k in range(0, 30, 3)]
    rows += [(300 + k, "very common line of words here " * (k + 10)) for k in range(6)]  # repeats: weights matter
    rows += [(400, None), (401, ""), (402, " \n"), (403, "a b"), (404, "A  b"), (405, "a b c")]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    found = N.near_classes(docs(spark, [(*r, "s", 0) for r in rows], ", class_id int")).collect()
    want = brute_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in found} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_drop_keeps_one_of_each(spark):
    rows = corpus()[:70]
    df = docs(spark, rows)
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(rows).values()))


def test_odd_inputs(spark):
    assert N.near_classes(docs(spark, [])).count() == 0
    found = N.near_classes(docs(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x " * 60_000)])).collect()
    assert len(found) == 4 and [(r["class_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(1, False)]
    assert {(r["class_size"], r["kept"]) for r in found if r["doc_id"] == 1} == {(3, True)}


def test_drop_of_null_ids_repeats_and_clashing_names(spark):
    near = " ".join([*words(100, 1)[:-1], "edit"])
    rows = [(None, prose(50, 9)), (None, prose(50, 9)), (None, prose(50, 8)), (7, prose(100, 1)), (7, prose(100, 1)), (8, near), (None, near), (9, None), (None, "")]
    df = docs(spark, [(*r, "s", 1, "x", 2, 3) for r in rows], ", __dropped int, row string, text_hash int, mark int")
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("None", prose(50, 9)), ("None", prose(50, 8)), ("7", prose(100, 1)), ("9", "")])


@pytest.mark.parametrize("weights", [(1, 1), (1, 3), (5, 9), (2, 1000)])
def test_signatures_are_unbiased(weights):
    rng = np.random.default_rng(7)
    n, m = 60, 4096
    d = rng.integers(0, 2**62, n).astype(np.uint64)
    e = d.copy()
    e[:15] = rng.integers(0, 2**62, 15)
    wa = rng.integers(1, weights[1] + 1, n)
    wb = np.maximum(1, wa + rng.integers(-1, 2, n))
    sig = B.signatures(np.r_[np.zeros(n, int), np.ones(n, int)], np.r_[d, e], np.r_[wa, wb], 2, m)
    order = np.argsort(d), np.argsort(e)
    truth = overlap((d[order[0]], wa[order[0]]), (e[order[1]], wb[order[1]]))
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * (truth * (1 - truth) / m) ** 0.5 + 1e-3


def test_signature_of_nothing():
    assert np.isinf(B.signatures(np.empty(0, int), np.empty(0, np.uint64), np.empty(0, int), 2, 8)).all()


def test_overlap_equals_counters():
    for seed in range(20):
        a, b = " ".join(words(80, seed, 4)), " ".join(words(60, seed + 100, 4))
        x, y = bag(a), bag(b)
        assert overlap(shingle_bag(a), shingle_bag(b)) == pytest.approx(sum((x & y).values()) / sum((x | y).values()))


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in got} and {i for p in links if p[0] != p[1] for i in p} <= set(got)


def test_one_id_with_two_texts(spark):
    near = lambda seed: " ".join([*words(100, seed)[:-1], "edit"])
    whole = lambda seed: " ".join(words(100, seed))
    rows = [(1, whole(1)), (1, whole(2)), (1, whole(3)), (2, near(1)), (3, near(2)), (4, near(3)), (5, whole(4)), (6, near(4)), (6, whole(5))]
    found = sorted((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in N.near_classes(docs(spark, rows)).collect())
    assert found == [(1, 1, 2, True)] * 3 + [(k, 1, 2, False) for k in (2, 3, 4)] + [(5, 5, 2, True), (6, 5, 2, False), (6, 6, 1, True)]
    left = sorted((r["doc_id"], r["text"]) for r in N.drop_near_duplicates(docs(spark, rows)).collect())
    assert left == sorted([*rows[:3], rows[6], rows[8]])


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def many_partitions(spark):
    return settings(spark, **{"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def checkpoint_files(spark):
    common.ensure_checkpoint_dir(spark)
    place = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return sum(f.startswith("part-") for _, _, files in os.walk(place) for f in files)


def test_few_links_take_few_tasks(spark):
    """Each task writes files in every shuffle and checkpoint of a round, so their number follows the links, not the setting."""
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    before = checkpoint_files(spark)
    with many_partitions(spark):
        roots = components(links)
        assert {r["root"] for r in roots.collect()} == {0}
        assert roots.rdd.getNumPartitions() == 1
    assert checkpoint_files(spark) - before < 64


def test_few_candidates_take_few_tasks(spark):
    rows = corpus()
    before = checkpoint_files(spark)
    with many_partitions(spark):
        found = N.near_classes(docs(spark, [(*r, "s", 0) for r in rows], ", class_id int")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(rows)
    assert checkpoint_files(spark) - before < 20 * 64  # 9 tables of sets, bags or pairs that were compared keep their tasks


def test_classes_of_larger_tables(spark, monkeypatch):
    """Where no table is small, none is broadcast or gathered."""
    monkeypatch.setattr(common, "TASK_ROWS", 1)
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    rows = corpus()
    found = N.near_classes(docs(spark, [(*r, "s", 0) for r in rows], ", class_id int")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(rows)


def test_gathered_keeps_rows_and_large_tables(spark):
    df = spark.range(0, 100, 1, 8)
    assert common.gathered(df, 100).rdd.getNumPartitions() == 1 and common.gathered(df, 100).count() == 100
    assert common.gathered(df, 4 * common.TASK_ROWS).rdd.getNumPartitions() == 8  # the session has 4 partitions
    assert common.gathered(df, 0).rdd.getNumPartitions() == 1
