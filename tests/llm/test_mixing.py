from __future__ import annotations

import re
from collections import defaultdict

import pytest

from pawnmill.llm import mixing as M
from tests.llm.helpers import docs, prose


def water_fill(sizes, total=1.5, most=2):
    """Shares by weight, the excess over a limit reshared until there is none."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(spark, rows, **how):
    found = M.mix_sources(docs(spark, rows), **how).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    goal, source = water_fill(sizes), {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    assert len(found) == len(rows)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.5 + 1e-6 for s in sizes)
    return {r["doc_id"]: r["taken"] for r in found}


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_targets_are_met(spark, block):
    rows = [(k, prose(1 + 13 * k % 90, k), ["a", "b", "c", "B", "ä", None, "tiny"][0 if k % 3 == 0 else k % 7 if k % 7 != 6 or k < 20 else 1]) for k in range(150)]
    rows += [(900, None, "a"), (901, " \n", None), (902, "one", "lone"), (903, None, "void")]
    one = check(spark, rows, block=block)
    assert one == check(spark, rows[::-1], block=block)


def test_schedule_is_low_discrepancy(spark):
    goals = spark.createDataFrame([("sa", 10**6, 500_000.0, 1), ("sb", 10**6, 200_000.0, 2), ("sc", 10**6, 100_000.0, 3)], "key string, source_size bigint, target double, nth int")
    rows = M.schedule(goals, 100).orderBy("slot").collect()
    count, share = defaultdict(int), {"sa": 5 / 8, "sb": 2 / 8, "sc": 1 / 8}
    for n, r in enumerate(rows, 1):
        count[r["key"]] += 1
        assert all(abs(count[k] - n * s) < 8 for k, s in share.items())
    words = defaultdict(int)
    for r in rows:
        words[r["key"]] += r["words"]
    assert words == {"sa": 500_000, "sb": 200_000, "sc": 100_000}


def test_documents(spark):
    rows = [(k, prose(50, k), ["a", "b"][k % 2]) for k in range(40)]
    df = docs(spark, [(*r, 1) for r in rows], ", taken int")
    mixed = M.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == pytest.approx(60, abs=2)
    assert {r["doc_id"] for r in mixed.collect()} <= {r[0] for r in rows}


def test_the_mix_is_written_in_the_order_of_its_slots(spark):
    """Any prefix of the output holds the sources near their targets; without the schedule it would not."""
    rows = [(k, prose(20, k), ["a", "b", "c"][k % 3]) for k in range(900)]
    df = docs(spark, [(*r, 1, 2, 3) for r in rows], ", slot int, __copies int, __copy int")
    mixed = M.mix_documents(df, block=40)
    assert mixed.columns == df.columns
    goals, count = {"a": 600 / 1350, "b": 500 / 1350, "c": 250 / 1350}, defaultdict(int)
    out = [r["source"] for r in mixed.collect()]
    assert len(out) == pytest.approx(1350, abs=3)
    for n, source in enumerate(out, 1):
        count[source] += 1
        assert all(abs(count[s] - n * g) < 25 for s, g in goals.items())
    slots = {r["doc_id"]: r["first_slot"] for r in M.mix_sources(df, block=40).collect()}
    first = list(dict.fromkeys(r["doc_id"] for r in mixed.collect()))
    assert [slots[k] for k in first] == sorted(slots[k] for k in first)


def test_repeated_ids(spark):
    rows = [(7, "a b c d"), (7, "e f"), (7, "e f"), (None, "g h i"), (None, "j")]
    assert sum(len(r["text"].split()) for r in M.mix_documents(docs(spark, rows)).collect()) == pytest.approx(18, abs=4)


def test_odd_inputs(spark):
    assert M.mix_sources(docs(spark, [])).count() == 0
    assert [r["taken"] for r in M.mix_sources(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]
    assert M.mix_documents(docs(spark, [])).count() == 0
    found = M.mix_sources(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "d e")])).collect()
    assert len(found) == 3 and sum(r["taken"] for r in found) == 12


def test_one_id_with_a_third_of_all_rows(spark):
    """Repeated rows of one id lie side by side on their source's line, wherever they were read."""
    rows = [(7, "a b c", "s")] * 60 + [(k, prose(5 + k % 9, k), "st"[k % 2]) for k in range(100, 220)] + [(7, "d e", "s")] * 5
    df = docs(spark, rows).repartition(6)
    found = M.mix_sources(df).collect()
    assert len(found) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    by = defaultdict(int)
    for r in found:
        by[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(abs(n - target) <= 0.5 + 1e-6 for (_, target), n in by.items())
    lines, _ = M._lines(df, M.WEIGHTS, M.TOTAL, M.MOST, "doc_id", "text", "source")
    spans = sorted((r["key"], r["start"], r["start"] + r["size"]) for r in lines.collect())
    assert all(a[2] == b[1] for a, b in zip(spans, spans[1:]) if a[0] == b[0])
