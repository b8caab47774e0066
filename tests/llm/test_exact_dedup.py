from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pawnmill.llm import exact_dedup as X
from tests.llm.helpers import docs

TEXTS = ["a b", "a  b", "a\t\nb", "A b", "", None, " ", "x" * 300_000, " a b"]


def brute(rows):
    groups, out = defaultdict(list), {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    for i, t in rows:
        g = groups[norm(t)]
        out[i] = (min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else "hot text") for i in range(300)] + [(i, f"own {i}") for i in range(300, 400)]
    found = {r["doc_id"]: tuple(r)[1:] for r in X.duplicate_groups(docs(spark, rows)).collect()}
    assert found == brute(rows)


def test_drop(spark):
    rows = [(5, "b"), (3, "b"), (4, "a"), (4, "a"), (None, "a"), (None, "c"), (9, None), (8, "")]
    df = docs(spark, [(*r, "s", 1) for r in rows], ", keep_id int")  # a clashing name
    kept = X.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((repr(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("3", "b"), ("4", "a"), ("None", "c"), ("8", "")])


def test_drop_with_string_ids_and_helper_names(spark):
    rows = [("null", "t"), (None, "t"), (None, "u"), (None, "u"), ("a", "u"), ("b", "v"), ("b", "v"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, 1, k, "r") for k, r in enumerate(rows)], "doc_id string, text string, __key int, mark int, row string")
    kept = X.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("'null'", "t"), ("'a'", "u"), ("'b'", "v"), ("None", "")])
    groups = X.duplicate_groups(df).collect()
    assert len(groups) == len(rows) and sum(r["kept"] for r in groups) == 4


def test_drop_from_a_join(spark):
    left = docs(spark, [(k % 50, f"text {k % 20}") for k in range(200)])
    joined = left.repartition(7, "doc_id").join(docs(spark, [(k, "x") for k in range(50)]).select("doc_id").hint("merge"), "doc_id")
    assert sorted(r["text"] for r in X.drop_duplicates(joined).collect()) == sorted({f"text {k}" for k in range(20)})


def test_empty(spark):
    assert X.duplicate_groups(docs(spark, [])).count() == 0
    assert X.drop_duplicates(docs(spark, [])).count() == 0


def test_no_python_in_plan(spark):
    plan = X.duplicate_groups(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_digest_just_below_the_heavy_bound_is_in_no_window(spark):
    rows = [(i, "copies" if i % 50 == 0 else f"own {i}") for i in range(3000)]
    df = X.duplicate_groups(docs(spark, rows))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert {r["doc_id"]: tuple(r)[1:] for r in df.collect()} == brute(rows)
