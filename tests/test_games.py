from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pawnmill import constants as C
from pawnmill.functions import scalar
from pawnmill.operators import games as G
from pawnmill.operators.vocabulary import token_list
from pawnmill.plans import prepare
from pawnmill.schemas import RAW_GAME

RUY = "1. e4 e5 2. Nf3 Nc6 3. Bb5 a6"


def raw(spark, *rows):
    base = {"movetext": RUY, "Result": "1-0", "WhiteElo": "1500", "BlackElo": "1500", "WhiteRatingDiff": "5", "BlackRatingDiff": "-7", "Termination": "Normal", "Event": "Rated Blitz game"}
    return spark.createDataFrame([{**base, **r} for r in rows], RAW_GAME)


def test_base_filter(spark):
    df = raw(spark, {}, {"Event": "Rated BLITZ tournament"}, {"Event": "Rated Bullet game"}, {"Event": None}, {"Termination": "Time forfeit"}, {"Termination": None})
    assert df.where(G.base_filter()).count() == 2


@pytest.mark.parametrize(
    ("w", "b", "dw", "db", "good"),
    [
        ("2100", "2080", "5", "-7", True),
        ("1999", "2080", "5", "-7", False),
        ("2100", "1500", "5", "-7", False),
        ("2100", "2080", "5", "-94", False),
        ("2100", "2080", "50", "-7", False),
        ("2400", "2100", "5", "-7", False),
        ("2000", "2200", "30", "-30", True),
        ("2100", "2080", None, "-7", False),
        ("?", "2080", "5", "-7", False),
    ],
)
def test_high_elo_filter(spark, w, b, dw, db, good):
    df = raw(spark, {"WhiteElo": w, "BlackElo": b, "WhiteRatingDiff": dw, "BlackRatingDiff": db})
    assert df.where(G.high_elo_filter()).count() == int(good)


def test_classifiers(spark):
    pairs = [("800", "1000", "<1200"), ("1199", "1199", "<1200"), ("1200", "1200", "1200-1600"), ("1500", "1700", "1600-2000"), ("1600", "1600", "1600-2000"), ("2000", "2000", "2000+"), ("2400", "2600", "2000+"), ("?", "1500", "unknown"), (None, "1500", "unknown")]
    df = spark.createDataFrame(pairs, "w string, b string, want string")
    assert df.where(scalar.elo_bucket("w", "b") != F.col("want")).count() == 0
    first = spark.createDataFrame([("e2e4", "e4"), ("d2d4", "d4"), ("c2c4", "c4"), ("g1f3", "Nf3"), ("b2b3", "other"), (None, "other")], "m string, want string")
    assert first.where(scalar.opening_family("m") != F.col("want")).count() == 0
    ply = spark.createDataFrame([(0, "opening"), (19, "opening"), (20, "middle"), (59, "middle"), (60, "endgame"), (200, "endgame")], "p int, want string")
    assert ply.where(scalar.phase("p") != F.col("want")).count() == 0
    results = spark.createDataFrame([("1-0", "white", "decisive"), ("0-1", "black", "decisive"), ("1/2-1/2", "draw", "draw"), ("*", None, "decisive")], "r string, o string, t string")
    assert results.where(scalar.outcome("r").eqNullSafe(F.col("o")) & (scalar.termination_type("r") == F.col("t"))).count() == 4


def test_examples(spark):
    df = raw(spark, {}, {"Result": "1/2-1/2"}, {"Result": "*"}, {"movetext": ""}, {"movetext": "1. e4 e5 2. Bc4 Nc6 3. Qh5 Nf6 4. Qxf7#"}, {"WhiteElo": "?"})
    rows = G.tokenized_examples(G.classify_games(G.parse_movetext(df)), token_list()).collect()
    assert len(rows) == 5
    assert sorted(r["input_ids"][0] for r in rows if r["result"] == "draw") == [C.WHITE_ID, C.BLACK_ID]
    assert all(r["input_ids"][-2:] == [C.DRAW_ID, C.EOS_ID] for r in rows if r["result"] == "draw")
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) and r["input_ids"][-1] == C.EOS_ID for r in rows)
    assert sum(r["elo_bucket"] == "unknown" for r in rows) == 1
    assert G.strip_metadata(spark.createDataFrame(rows)).columns == ["input_ids", "attention_mask"]


def test_prepare(spark, tmp_path):
    results = ["1-0", "0-1", "1/2-1/2"]
    df = raw(spark, *[{"Result": results[k % 3], "WhiteElo": str(900 + 40 * (k % 40))} for k in range(240)], {"Result": "*"}, {"Event": "Bullet"})
    counts = prepare.prepare(spark, df, str(tmp_path / "out"))
    assert (counts.games, counts.skipped, counts.examples) == (241, 1, 320)
    assert (counts.eval, counts.test, counts.train) == (13, 3, 304)
    assert not (tmp_path / "out" / "_shards").exists()
    assert spark.read.parquet(str(tmp_path / "out" / "splits")).columns == ["input_ids", "attention_mask", "split"]


def test_filters_precede_parsing(spark):
    plan = G.parse_movetext(prepare.select_games(raw(spark, {}), high_elo=True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.rindex("blitz")  # below it in the tree
