from __future__ import annotations

import random
from collections import defaultdict

from pawnmill.operators import batching as B


def test_budget_and_padding(spark):
    rng = random.Random(2)
    rows = [(k, int(rng.lognormvariate(4, 1))) for k in range(1200)] + [(5000, None), (5001, 0), (5002, 9000)] + [(6000 + k, 33) for k in range(500)]
    found = B.budget_batches(spark.createDataFrame(rows, "id int, n int").repartition(6), "n", 4096, "id").collect()
    assert sorted(r["id"] for r in found) == sorted(k for k, _ in rows)
    batches = defaultdict(list)
    for r in found:
        batches[r["padded_to"], r["batch"]].append(r)
    for (padded, _), own in batches.items():
        assert all((r["n"] or 0) <= padded for r in own) and (len(own) * padded <= 4096 or len(own) == 1)
        assert sorted(r["place"] for r in own) == list(range(len(own)))
    for padded in {p for p, _ in batches}:  # all batches of a class but the last are full, and numbers have no gaps
        sizes = [len(batches[padded, k]) for k in sorted(k for p, k in batches if p == padded)]
        assert all(n == max(1, 4096 // padded) for n in sizes[:-1])
    padding = sum(r["padded_to"] - (r["n"] or 0) for r in found)
    fixed = [rows[k : k + 8] for k in range(0, len(rows), 8)]
    assert padding < sum(max(n or 0 for _, n in b) * len(b) - sum(n or 0 for _, n in b) for b in fixed) / 4


def test_empty(spark):
    assert B.budget_batches(spark.createDataFrame([], "id int, n int"), "n", 10, "id").count() == 0
