from __future__ import annotations

from datetime import datetime

import pytest

from pawnmill.plans import runs as R

NOW = datetime(2026, 4, 19, 20, 15, 0)


def test_run_id():
    assert R.make_run_id("marvelous-deer-608-ckpt9660", "vs_stockfish", NOW) == "2026-04-19T20-15-00_marvelous-deer-608-ckpt9660_vs-stockfish"
    with pytest.raises(ValueError):
        R.make_run_id("a_b", "perplexity", NOW)


def test_tags(tmp_path):
    (tmp_path / "my_run" / "checkpoint-96").mkdir(parents=True)
    assert R.derive_checkpoint_tag("org/name") == "name"
    assert R.derive_checkpoint_tag(str(tmp_path / "my_run" / "checkpoint-96")) == "my_run-ckpt96"
    assert R.resolve_checkpoint_tag(str(tmp_path / "my_run" / "checkpoint-96")) == "my-run-ckpt96"
    assert R.derive_checkpoint_tag(str(tmp_path / "other" / "checkpoint-1")) == "checkpoint-1"
    assert R.derive_checkpoint_tag("./a/b") == "b"
    assert R.resolve_checkpoint_tag("org/name", "tag") == "tag"
    with pytest.raises(ValueError):
        R.resolve_checkpoint_tag("org/name", "t_g")


@pytest.mark.parametrize("bad", [{"games": 0}, {"stockfish_skill": 21}, {"stockfish_skill": -1}, {"max_plies": 0}, {"record_top_k": -1}, {"stockfish_depth": None}, {"stockfish_depth": 0}, {"model_color": "red"}])
def test_match_config(bad):
    with pytest.raises(ValueError):
        R.MatchConfig(**bad)


def test_other_configs():
    for bad in ({}, {"positions_path": "a", "sample_from_games_path": "b"}, {"sample_from_games_path": "b", "sample_n": 0}):
        with pytest.raises(ValueError):
            R.LegalRateConfig(**bad)
    with pytest.raises(ValueError):
        R.PerplexityConfig("x", 0)
    assert R.MatchConfig(stockfish_movetime=0.5, stockfish_depth=None).limit() == {"time": 0.5}
    assert R.MatchConfig().limit() == {"depth": 1}


def test_payload():
    fen = R.config_payload("legal_rate", "r", "c", R.LegalRateConfig(positions_path="p"), {"temperature": 0.5, "run_id": "late"})
    assert "seed" not in fen and "sample_n" not in fen and fen["run_id"] == "late"
    pgn = R.config_payload("legal_rate", "r", "c", R.LegalRateConfig(sample_from_games_path="p"))
    assert (pgn["sample_n"], pgn["seed"]) == (10_000, 0)


def test_run_folder(spark, tmp_path):
    run = R.Run(spark, str(tmp_path / "run"))
    run.write_config({"evaluator": "perplexity"})
    run.write_config({"evaluator": "legal_rate"})
    assert run.read_config() == {"evaluator": "legal_rate"}
    run.write_metrics({"a": 1})
    run.write_pgn(["one\n", "two\n"])
    assert run.read_metrics() == {"a": 1} and run.read_pgn() == "one\n\ntwo\n"
