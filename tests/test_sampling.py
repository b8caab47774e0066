from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pawnmill.operators import sampling as S


def table(spark, n, strata=4):
    return spark.range(n).select(F.col("id"), (F.col("id") % strata).cast("string").alias("elo"), F.when(F.col("id") % 3 == 0, "draw").otherwise("white").alias("result"))


def test_sizes():
    assert S.split_sizes(1000) == (40, 10)
    assert S.split_sizes(62) == (2, 1)  # 2.48 and 0.62
    with pytest.raises(ValueError):
        S.split_sizes(3)


@pytest.mark.parametrize(("n", "n_eval", "n_test"), [(400, 20, 5), (200, 40, 10)])
def test_three_way(spark, n, n_eval, n_test):
    rows = S.three_way_split(table(spark, n), ["elo", "result"], "id", n_eval, n_test).collect()
    assert Counter(r["split"] for r in rows) == {"train": n - n_eval - n_test, "eval": n_eval, "test": n_test}
    assert len({r["id"] for r in rows}) == n
    assert {r["elo"] for r in rows if r["split"] == "eval"} == {"0", "1", "2", "3"}


def test_repeatable_and_independent_of_partitions(spark):
    df = table(spark, 500)
    one = {r["id"] for r in S.stratified_holdout(df, ["elo"], 37, "id", 1).collect()}
    assert one == {r["id"] for r in S.stratified_holdout(df.repartition(7), ["elo"], 37, "id", 1).collect()}
    assert len(one) == 37 and one != {r["id"] for r in S.stratified_holdout(df, ["elo"], 37, "id", 2).collect()}


def test_skewed_and_null_strata(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") >= 10, "hot").when(F.col("id") >= 5, F.col("id").cast("string")).alias("s"))
    rows = S.stratified_holdout(df, ["s"], 300, "id").collect()
    assert len(rows) == 300
    assert {"hot"} < {r["s"] for r in rows}  # the cut to size is blind to strata


def test_groups_stay_together(spark):
    df = table(spark, 400).withColumn("game", F.floor(F.col("id") / 2))
    rows = S.three_way_split(df, ["elo"], "id", 20, 5, group_key="game").collect()
    where = {}
    for r in rows:
        where.setdefault(r["game"], set()).add(r["split"])
    assert all(len(s) == 1 for s in where.values())


def test_reservoir(spark):
    games = spark.createDataFrame([("g0", ["a", "b", "c", "d"]), ("g1", ["e", "f", "g", "h"]), ("g2", [])], "game string, moves array<string>")
    positions = S.positions_of(games, "game", "moves")
    assert positions.count() == 8
    assert {tuple(r["moves"]) for r in positions.where("game = 'g0'").collect()} == {(), ("a",), ("a", "b"), ("a", "b", "c")}
    pick = lambda n, seed: {(r["game"], r["ply"]) for r in S.reservoir(positions, n, "game", "ply", seed=seed).collect()}
    assert len(pick(4, 0)) == 4 and pick(4, 0) == pick(4, 0) and len(pick(1000, 0)) == 8
    assert S.reservoir(positions.where("false"), 4, "game", "ply").count() == 0


def test_first_games_keeps_partitions(spark, tmp_path):
    spark.range(0, 500, 1, 7).write.parquet(str(tmp_path / "f"))
    df = spark.read.parquet(str(tmp_path / "f")).where("id % 3 <> 0")
    for n in (1, 50, 90, 333, 334, 5000):
        assert sorted(r["id"] for r in S.first_games(df, n).collect()) == [k for k in range(500) if k % 3][:n]
    plan = S.first_games(df, 120)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan
    shuffled = spark.range(300).repartition(5)
    assert sorted(r["id"] for r in S.first_games(shuffled, 40, "id").collect()) == list(range(40))
    assert S.first_games(shuffled, 40).count() == 40
    assert S.first_games(spark.range(0), 5).count() == 0


@pytest.mark.parametrize("repeats", [1, 40])
def test_row_ids_do_not_hang_on_partitions(spark, tmp_path, repeats):
    rows = [(k % (200 // repeats), "s") for k in range(200)]
    found = []
    for parts in (1, 3, 16):
        path = str(tmp_path / f"p{parts}")
        spark.createDataFrame(rows, "k int, s string").repartition(parts).write.parquet(path)
        for df in (spark.read.parquet(path), spark.createDataFrame(rows, "k int, s string").repartition(parts)):
            ids = S.with_row_ids(df, F.col("k").cast("string"))
            found.append(sorted((r["k"], r["row_id"]) for r in ids.collect()))
            assert len(set(found[-1])) == 200
    assert all(f == found[0] for f in found)


def test_prepared_splits_do_not_hang_on_partitions(spark, tmp_path):
    from pawnmill.plans import prepare
    from tests.test_games import RUY, raw

    df = raw(spark, *[{"movetext": RUY + f" 4. {'abcdefgh'[k % 8]}3", "WhiteElo": str(900 + k)} for k in range(150)])
    splits = []
    for parts in (1, 5):
        df.repartition(parts).write.parquet(str(tmp_path / f"raw{parts}"))
        counts = prepare.prepare(spark, spark.read.parquet(str(tmp_path / f"raw{parts}")), str(tmp_path / f"out{parts}"))
        splits.append(sorted((r["split"], tuple(r["input_ids"])) for r in spark.read.parquet(str(tmp_path / f"out{parts}/splits")).collect()))
        assert counts.games == 150
    assert splits[0] == splits[1]


def test_balanced_and_excluded(spark):
    df = spark.createDataFrame([(k, "ab"[k % 10 == 0] if k % 50 else None) for k in range(500)], "id int, v string")
    n = {r["v"]: r["count"] for r in S.balanced_sample(df, "v", 20, "id").groupBy("v").count().collect()}
    assert n == {"a": 20, "b": 20, None: 10} or n == {"a": 20, "b": 20}
    assert S.excluding(df, df.where("id < 100"), "id").count() == 400


def test_sampled_positions(spark):
    df = spark.createDataFrame([(f"g{k}", [f"m{j}" for j in range(k)]) for k in range(12)], "g string, m array<string>")
    every = {(r["g"], r["ply"]): r["m"] for r in S.positions_of(df, "g", "m").collect()}
    found = S.sampled_positions(df, 15, "g", "m").collect()
    assert len(found) == 15 and all(every[r["g"], r["ply"]] == r["m"] for r in found)
    assert S.sampled_positions(df, 10**6, "g", "m").count() == len(every)


def selected(spark, rows, quotas, groups=("g",), ranked=8):
    df = spark.createDataFrame(rows, "id bigint, g string").repartition(5)
    table = spark.createDataFrame([(g, q, sum(r[1] == g for r in rows)) for g, q in quotas.items()], "g string, __quota bigint, __n bigint")
    return S.selection.first_in_groups(df, list(groups), table, S.hash_order(3, "id"), "id", ranked=ranked)


def test_selection_refines_a_histogram(spark):
    """Quotas far beyond what is ranked, one for each of several strata, a null one among them."""
    rows = [(k, ["hot", "hot", "cold", None][k % 4]) for k in range(6000)]
    quotas = {"hot": 1713, "cold": 1, None: 1500}
    df = selected(spark, rows, quotas)
    found = {}
    for r in df.collect():
        found.setdefault(r["g"], []).append(r["id"])
    md5 = lambda k: __import__("hashlib").md5(f"3:{k}".encode()).hexdigest()
    for g, q in quotas.items():
        assert sorted(found[g]) == sorted(sorted((k for k, h in rows if h == g), key=md5)[:q])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan and "Exchange hash" not in plan


@pytest.mark.parametrize("repeats", [6, 900])
def test_selection_cuts_repeated_ids(spark, repeats):
    rows = [(k // repeats, "a") for k in range(1800)]
    found = Counter(r["id"] for r in selected(spark, rows, {"a": 1234}).collect())
    assert sum(found.values()) == 1234
    assert sum(n < repeats for n in found.values()) <= 1


def test_first_rows_of_a_fraction(spark):
    df = spark.range(5000)
    order = S.hash_order(1, "id")
    want = {r["id"] for r in df.orderBy(order, "id").limit(2500).collect()}
    some = S.selection.first_rows(df, 2500, order, "id", ranked=10)
    assert {r["id"] for r in some.collect()} == want
    assert "SinglePartition" not in some._jdf.queryExecution().executedPlan().toString()
    assert S.selection.first_rows(df, 0, order, "id").count() == 0 and S.selection.first_rows(df, 9000, order, "id").count() == 5000
    assert S.selection.first_rows(spark.range(0), 5, order, "id").count() == 0


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_bottom_k_equals_the_reservoir(spark, parts):
    df = spark.range(3000).selectExpr("id", "id % 7 AS g").repartition(parts)
    want = {r["id"] for r in S.reservoir(df, 40, "id").collect()}
    sketch = S.bottom_k(df, 40, "id", fan=4)
    assert {r["id"] for r in sketch.collect()} == want and sketch.columns == df.columns
    assert S.bottom_k(df, 5000, "id").count() == 3000 and S.bottom_k(df.limit(0), 5, "id").count() == 0
    half = S.bottom_k(df.where("id < 1700"), 40, "id")
    for _ in range(2):  # the second time adds nothing
        half = S.merge_sketch(half, df.where("id >= 1500"), 40, "id")
        assert {r["id"] for r in half.collect()} == want
