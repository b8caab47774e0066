from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from pawnmill.llm import filter_audit
from tests.llm.helpers import DOCS, docs, prose

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(t, i, texts):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    least = min((j for j, u in texts if u == t and j is not None), default=None)
    return {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least is not None and least < i,
    }


def brute(rows, labels):
    texts = [(r[0], r[1] or "") for r in rows]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    each = [(r[2] or "", {f for f, bad in fails(r[1] or "", r[0], texts).items() if bad}, r[0] in good and r[0] is not None, r[0] in toxic and r[0] is not None) for r in rows]
    out, totals = {}, Counter()
    for part in {e[0] for e in each}:
        own = [e for e in each if e[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [e for e in own if f in e[1] and not e[1] & set(order[:k])]
                kept = sum(not e[1] & set(order[: k + 1]) for e in own)
                redundant = sum(f in e[1] and bool(e[1] & set(order[:k])) for e in own)
                out[part, order, k + 1] = (kept, len(here), redundant, sum(e[1] == {f} for e in own), sum(e[2] for e in here), sum(e[3] for e in here))
                totals[part, f] += len(here)
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df, labels):
    rows = filter_audit.audit_filters(df, labels).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*FIELDS, "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


ROWS = [
    (1, prose(300, 1), "en"), (2, prose(300, 1), "en"), (3, "word " * 300, "de"), (4, prose(250, 2) + " #", None), (5, prose(250, 3).upper(), ""), (6, None, "en"), (7, "", "en"), (8, " \t\n ", "x"), (None, prose(300, 1), "en"),
    (None, None, None), (1, prose(300, 1), "en"), (9, " ".join(f"W{i}" for i in range(199)) + "\x0b\x0c\r x", "de"), (9, prose(300, 9), "de"), (-5, "word " * 300, "fr"), (10, "Ünï😀 " * 250, "fr"), (11, "a" * 100_000, "fr"), (12, prose(40_000, 5), "fr"),
    *[(k, prose(10, 3), "en") for k in range(100, 140)], *[(77, "A $ " * 120, "en")] * 30,
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (None, 1, 1), (77, 1, 1), (77, 1, 1), (9, 1, 0), (500, 1, 1), (4, 1, 0)]


def test_every_order_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, lang, "s", 0, 1, 2) for i, t, lang in ROWS], DOCS + ", id int, `mark` int")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    assert found(df, labels) == brute(ROWS, LABELS)
    assert found(df.limit(0), labels) == {}
    unlabelled = found(df, labels.limit(0))
    assert all(v[4] == v[5] == 0 for v in unlabelled.values()) and len(unlabelled) == 5 * 600


def test_words_of_copies_are_counted_once_for_each(spark):
    df = docs(spark, [(1, "a b b"), (1, "a b b"), (1, "c"), (2, None), (None, "a  a")])
    rows = filter_audit.word_totals(df).collect()
    assert sorted((repr(r["id"]), r["words"], r["distinct"]) for r in rows) == [("1", 1, 1), ("1", 3, 2), ("2", 0, 0), ("None", 2, 1)]


def test_words_need_one_shuffle_of_texts(spark):
    """Exploded words are counted where their document was dealt to: no exchange has words in it."""
    plan = filter_audit.word_totals(docs(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 2 and not any("word" in line for line in exchanges)
