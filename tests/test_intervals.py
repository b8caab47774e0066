from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pawnmill.functions import scalar
from pawnmill.operators import intervals as I


def brute(points, ranges):
    inside = lambda v, a, b: v is not None and not math.isnan(v) and (a is None or a <= v) and (b is None or v < b)
    return sorted((p, r) for p, v in points for r, a, b in ranges if inside(v, a, b))


@pytest.mark.parametrize("bins", [1, 16, 1 << 16])
def test_equals_every_pair(spark, bins):
    rng = random.Random(bins)
    points = [(k, round(rng.gauss(0, 50), 1)) for k in range(300)] + [(1000, None), (1001, float("nan")), (1002, 7.0)] + [(2000 + k, 7.0) for k in range(40)]
    ends = [sorted((round(rng.uniform(-150, 150), 1), round(rng.uniform(-150, 150), 1))) for _ in range(40)]
    ranges = [(k, a, b) for k, (a, b) in enumerate(ends)] + [(50, None, 0.0), (51, 7.0, None), (52, None, None), (53, 7.0, 7.0), (54, 9.0, 3.0), (55, -1e9, -1e8), (56, 1e8, None), (57, 7.0, 7.1), (58, 6.9, 7.0)]
    p = spark.createDataFrame(points, "p int, v double")
    r = spark.createDataFrame(ranges, "r int, low double, high double")
    found = I.interval_join(p, "v", r, bins=bins)
    assert sorted((x["p"], x["r"]) for x in found.collect()) == brute(points, ranges)
    left = I.interval_join(p, "v", r.where("r < 40"), how="left", bins=bins).collect()
    assert {x["p"] for x in left} == {k for k, _ in points} and sorted((x["p"], x["r"]) for x in left if x["r"] is not None) == brute(points, ranges[:40])


def test_rows_of_ranges_stay_few(spark):
    """One range over everything beside many short ones takes few bins."""
    p = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    r = spark.createDataFrame([(k, float(k), float(k + 1)) for k in range(500)] + [(999, None, None)], "r int, low double, high double")
    least, most, width = I.bin_layout(p, "v", r, "low", "high")
    bins = sum(math.floor((min(b, most) - least) / width) - math.floor((a - least) / width) + 1 for a, b in [(k, k + 1) for k in range(500)] + [(least, most)])
    assert bins <= 3 * 501
    assert I.interval_join(p, "v", r).count() == 10_500


def test_empty_sides_and_other_types(spark):
    p = spark.createDataFrame([(1, 5), (2, None)], "p int, v int")
    r = spark.createDataFrame([(1, 5, 6)], "r int, low int, high int")
    assert [tuple(x) for x in I.interval_join(p, "v", r).collect()] == [(1, 5, 1, 5, 6)]
    assert I.interval_join(p, "v", r.limit(0)).count() == 0 and I.interval_join(p.limit(0), "v", r).count() == 0
    assert I.interval_join(p, "v", r.limit(0), how="left").count() == 2
    days = spark.sql("SELECT 1 AS p, TIMESTAMP '2024-01-05 10:00:00' AS v")
    weeks = spark.sql("SELECT 'w1' AS w, TIMESTAMP '2024-01-01' AS low, TIMESTAMP '2024-01-08' AS high UNION ALL SELECT 'w2', TIMESTAMP '2024-01-08', NULL")
    assert [x["w"] for x in I.interval_join(days, "v", weeks).collect()] == ["w1"]


@pytest.mark.parametrize("bits", [1, 2, 6])
def test_aggregates_equal_those_of_every_pair(spark, bits):
    rng = random.Random(bits)
    points = [(k, round(rng.gauss(0, 50), 1)) for k in range(300)] + [(1000, None), (1001, float("nan")), (1002, 7.0)] + [(2000 + k, 7.0) for k in range(40)]
    ends = [sorted((round(rng.uniform(-150, 150), 1), round(rng.uniform(-150, 150), 1))) for _ in range(60)]
    ranges = [(k % 50, a, b) for k, (a, b) in enumerate(ends)] + [(60, None, 0.0), (61, 7.0, None), (None, None, None), (63, 7.0, 7.0), (64, 9.0, 3.0), (65, -1e9, -1e8), (66, 1e8, None), (67, 7.0, 7.1), (68, 6.9, 7.0)]
    p, r = spark.createDataFrame(points, "p int, v double"), spark.createDataFrame(ranges, "r int, low double, high double")
    found = I.interval_aggregate(p, "v", r, "r", least={"first": "p", "small": "v"}, greatest={"large": "v"}, bits=bits)
    want, value = {}, dict(points)
    for k, of in ((k, of) for k, v in points for of, a, b in ranges if v is not None and not math.isnan(v) and (a is None or a <= v) and (b is None or v < b)):
        want.setdefault(of, []).append(k)
    assert {x["r"]: (x["n"], x["first"], x["small"], x["large"]) for x in found.collect()} == {of: (len(ks), min(ks), min(value[k] for k in ks), max(value[k] for k in ks)) for of, ks in want.items()}
    assert I.interval_aggregate(p.limit(0), "v", r, "r").count() == 0 and I.interval_aggregate(p, "v", r.limit(0), "r").count() == 0


def test_aggregates_make_no_pairs(spark):
    """3,000 ranges over most of 20,000 values: 40 million pairs, but no join makes more than a few rows a range."""
    p = spark.range(20_000).select("id", F.col("id").cast("double").alias("v"))
    r = spark.range(3_000).select(F.col("id").alias("r"), F.col("id").cast("double").alias("low"), (20_000 - F.col("id")).cast("double").alias("high"))
    made = I.interval_aggregate(p, "v", r, "r", least={"first": "id"})
    assert {(x["n"] + 2 * x["r"], x["first"] - x["r"]) for x in made.collect()} == {(20_000, 0)}
    plan, rows = [made._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        plan += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        rows += [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
    assert len(rows) == 3 and 0 < max(rows) <= 6 * 3_000


def test_buckets_by_data_equal_buckets_by_constants(spark):
    values = [None, -5.0, 0.0, 2499.99, 2500.0, 4999.0, 5000.0, 1e9]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    bounds = [(0.0, "<0"), (2500.0, "0-2500"), (5000.0, "2500-5000")]
    table = spark.createDataFrame(bounds, "bound double, label string")
    mine = {r["k"]: r["bucket"] for r in I.bucketize_by(df, "v", table, "bound", "label", "5000+", unknown="unknown").collect()}
    fixed = {r["k"]: r["b"] for r in df.select("k", scalar.bucketize("v", bounds, "5000+", "unknown").alias("b")).collect()}
    assert mine == fixed
