from __future__ import annotations

import json

import pytest

from pawnmill.chess.board import START_FEN
from pawnmill.sources import scans, sinks

AFTER = "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0 2"
PGN = '[Event "a"]\n[Result "1-0"]\n\n1. e4 e5 2. Nf3 Nc6 1-0\n\n[Event "b"]\n\n1. d4 d5 2. c4 e6 *\n'


def test_fen_lines(spark, tmp_path):
    p = tmp_path / "positions.fen"
    p.write_text(f"{START_FEN}\n\n{AFTER}\n")
    assert {tuple(r) for r in scans.read_fens(spark, str(p)).collect()} == {("positions.fen:1", START_FEN), ("positions.fen:3", AFTER)}
    p.write_text(f"{START_FEN}\nnonsense\n")
    with pytest.raises(Exception, match="positions.fen:2: invalid FEN"):
        scans.read_fens(spark, str(p)).collect()


def test_sequences(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    good = {"id": "a", "perspective": "white", "moves": ["e2e4"]}
    p.write_text("\n".join([json.dumps(good), "", json.dumps(good | {"id": "b", "is_draw": True})]))
    rows = scans.read_sequences(spark, str(p)).orderBy("lineno").collect()
    assert [(r["lineno"], r["id"], r["is_draw"]) for r in rows] == [(1, "a", False), (3, "b", True)]
    assert scans.read_sequences(spark, str(p), most=1).count() == 1
    for bad in (good | {"perspective": "draw"}, {"id": "a", "moves": ["e2e4"]}, good | {"moves": []}, good | {"moves": "e2e4"}, [1], "{"):
        p.write_text(json.dumps(good) + "\n" + (bad if isinstance(bad, str) else json.dumps(bad)))
        with pytest.raises(Exception, match="s.jsonl:2"):
            scans.read_sequences(spark, str(p)).collect()
        assert scans.read_sequences(spark, str(p), most=1).count() == 1
        assert scans.read_sequences(spark, str(p), quarantine=True).where("_error IS NOT NULL").count() == 1


def test_pgn(spark, tmp_path):
    (tmp_path / "g.pgn").write_text(PGN)
    rows = scans.read_pgn(spark, str(tmp_path / "g.pgn")).orderBy("game_index").collect()
    assert [(r["game_id"], r["moves"]) for r in rows] == [("game-0000", ["e2e4", "e7e5", "g1f3", "b8c6"]), ("game-0001", ["d2d4", "d7d5", "c2c4", "e7e6"])]
    (tmp_path / "empty.pgn").write_text("")
    assert scans.read_pgn(spark, str(tmp_path / "empty.pgn")).count() == 0


def test_puzzles(spark, tmp_path):
    (tmp_path / "p.csv").write_text("PuzzleId,FEN,Moves,Rating,Themes\n1,x,e2e4 e7e5,1200,fork pin\n2,y,a2a3,900,mate\n3,z,a2a4,1300,pin\n")
    path = str(tmp_path / "p.csv")
    assert scans.read_puzzles(spark, path, rating=(1000, 1300)).count() == 2
    assert scans.read_puzzles(spark, path, themes=["mate", "fork"]).count() == 2
    assert scans.read_puzzles(spark, path, sample=1).count() == 1


def test_shards_and_splits(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "case when id < 7 then 'train' when id < 9 then 'eval' else 'test' end as split")
    sinks.write_shards(df.coalesce(1), str(tmp_path / "shards"), 4)
    assert len(list((tmp_path / "shards").glob("part-*.parquet"))) == 3
    sinks.write_splits(df, str(tmp_path / "splits"))
    assert scans.read_split(spark, str(tmp_path / "splits"), "eval").count() == 2
    plan = scans.read_split(spark, str(tmp_path / "splits"), "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert sinks.name_splits(spark, str(tmp_path / "splits")) == ["eval.parquet", "test.parquet", "train.parquet"]
    assert scans.read_split(spark, str(tmp_path / "splits"), "train").count() == 7 and scans.read_split(spark, str(tmp_path / "splits"), "test").count() == 1


def test_vocabulary_sink(spark, tmp_path):
    path = sinks.write_vocabulary(spark, ["a", "b"], str(tmp_path), "x")
    assert path.endswith("x-vocab.json") and json.loads(sinks.read_small(spark, path)) == {"a": 0, "b": 1}


def test_pushdown(spark, tmp_path):
    from pawnmill.operators.games import base_filter
    from pawnmill.schemas import RAW_GAME

    spark.createDataFrame([], RAW_GAME).write.parquet(str(tmp_path / "g"))
    plan = scans.read_games(spark, str(tmp_path / "g")).where(base_filter()).select("movetext")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Termination,Normal)" in plan and "WhiteElo" not in plan.split("ReadSchema")[1]


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of some 60 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "60")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    lines = {f: [("" if k % 4 == 3 else f"{f} line {k}" * (1 + k % 5)) for k in range(40)] for f in ("a.txt", "b.txt")}
    for f, v in lines.items():
        (tmp_path / f).write_text("\r\n".join(v) if f == "b.txt" else "\n".join(v) + "\n")
    rows = scans.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    assert {(r["file"], r["lineno"]): r["value"] for r in rows.collect()} == {(f, k + 1): x for f, v in lines.items() for k, x in enumerate(v) if x}


def test_games_are_numbered_over_files_and_splits(spark, tmp_path, small_splits):
    game = lambda f, k: f'[Event "{f}{k}"]\n[Site "[x]"]\n\n1. e4 {{ a [%clk 1] }} e5 {k + 2}. Nf3 *\n'
    for f, n in (("b.pgn", 5), ("a.pgn", 9), ("c.pgn", 2)):
        text = "\n".join(game(f, k) for k in range(n))
        (tmp_path / f).write_text(text.replace("\n", "\r\n") if f == "c.pgn" else text, newline="")
    rows = scans.read_pgn(spark, str(tmp_path)).orderBy("game_id").collect()
    want = [(f, k) for f, n in (("a.pgn", 9), ("b.pgn", 5), ("c.pgn", 2)) for k in range(n)]
    assert [(r["game_id"], r["headers"]["Event"], r["game_index"]) for r in rows] == [(f"game-{i:04d}", f"{f}{k}", k) for i, (f, k) in enumerate(want)]
    assert all(r["moves"] == ["e2e4", "e7e5", "g1f3"] for r in rows)


def test_documents_and_shard_names(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n "a": 1,\n "b": "x"\n}')
    assert tuple(scans.read_json_document(spark, str(tmp_path / "d.json")).first()) == (1, "x")
    assert scans.read_text_document(spark, str(tmp_path / "d.json")).count() == 1
    sinks.write_shards(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    assert sinks.name_shards(spark, str(tmp_path / "s")) == [f"shard_0000{k}.parquet" for k in range(3)]
    assert scans.read_shards(spark, str(tmp_path / "s")).count() == 10
