"""Queries of scans, sinks, preparation, streams and reports; what they write lies in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .functions import arrays, scalar
from .operators import games, metrics, preferences, records, sampling, scoring, vocabulary
from .plans import evaluate, prepare, report, runs
from .queries import MOVETEXTS, _as_games, query, table
from .session import scratch
from .sources import record_log as record_log_sink
from .sources import scans, sinks


def raw_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of raw games; movetexts are the fixed ones, by key."""
    texts = F.array(*[F.lit(t) for _, t, _ in MOVETEXTS])
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.get(texts, (key % len(MOVETEXTS)).cast("int")).alias("movetext"),
        scalar.map_default("o_orderstatus", {"F": "1-0", "O": "0-1", "P": "1/2-1/2"}, "*").alias("Result"),
        F.when(key % 13 == 0, "?").otherwise((800 + key % 1900).cast("string")).alias("WhiteElo"),
        (900 + F.col("o_custkey") % 1700).cast("string").alias("BlackElo"),
        (key % 40).cast("string").alias("WhiteRatingDiff"),
        (-(key % 33)).cast("string").alias("BlackRatingDiff"),
        F.when(key % 10 != 0, "Normal").otherwise("Time forfeit").alias("Termination"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 3 == 0, "Rated Bullet game").otherwise("Rated Blitz game").alias("Event"),
    )


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def _sequences(examples: DataFrame) -> DataFrame:
    return vocabulary.with_tokens(examples, "input_ids", vocabulary.token_list()).withColumn("sequence", F.array_join("tokens", " ")).drop("tokens", "input_ids", "attention_mask")


@query
def process_games(spark, sf_dir):
    """Raw games to labelled examples: parsing, classes, one row for each perspective."""
    parsed = games.parse_movetext(raw_games(spark, sf_dir))
    return _sequences(games.tokenized_examples(games.classify_games(parsed), vocabulary.token_list(), keep=("o_orderkey",)))


@query
def prepare_examples(spark, sf_dir):
    """The first 2,000 games after the filters, as files hold them; skipped ones are counted among them."""
    path = scratch(spark, "raw")
    raw_games(spark, sf_dir).repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    chosen = prepare.select_games(spark.read.parquet(path), 2000, order=("o_orderkey",))
    return _sequences(games.tokenized_examples(games.classify_games(games.parse_movetext(chosen)), vocabulary.token_list(), keep=("o_orderkey",)))


@query
def high_elo_games(spark, sf_dir):
    """Both filters at limits given with the command."""
    return prepare.select_games(raw_games(spark, sf_dir), None, True, min_elo=1200, max_diff=25, max_gap=300).select("o_orderkey")


@query
def first_rows(spark, sf_dir):
    """The first 1,000 rows of a file, in their partitions."""
    return sampling.first_games(table(spark, sf_dir, "orders"), 1000).select("o_orderkey")


@query
def strip_columns(spark, sf_dir):
    tagged = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"), *[F.lit("x").alias(c) for c in C.METADATA_COLUMNS])
    return games.strip_metadata(tagged)


@query
def raw_game_scan(spark, sf_dir):
    """Games written and read with the declared schema, filtered."""
    path = scratch(spark, "games")
    raw_games(spark, sf_dir).drop("o_orderkey").write.parquet(path)
    kept = scans.read_games(spark, path).where(games.base_filter())
    return kept.groupBy("Result", "movetext").agg(F.count(F.lit(1)).alias("n"))


@query
def shard_round_trip(spark, sf_dir):
    """Shards of at most 500 rows, numbered by name, read back; every row's shard has a number's name."""
    path = scratch(spark, "shards")
    sinks.write_shards(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, 500)
    sinks.name_shards(spark, path)
    rows = scans.read_shards(spark, path).select("o_orderkey", "o_custkey", F.col("_metadata.file_name").alias("shard"))
    return rows.select("o_orderkey", "o_custkey", F.rlike("shard", F.lit(r"^shard_[0-9]{5}\.parquet$")).alias("numbered"))


@query
def split_round_trip(spark, sf_dir):
    """Splits written by folder; one of them read."""
    path = scratch(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n_eval, n_test = sampling.split_sizes(docs.count())
    sinks.write_splits(sampling.three_way_split(docs, ["lang"], "doc_id", n_eval, n_test, seed=42), path)
    return scans.read_split(spark, path, "eval").select("doc_id", "lang")


def _label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = {"run_id": F.lit("r"), "evaluator": F.lit("legal_rate"), "checkpoint": F.lit("c"), "record_type": F.lit("per_legal_rate")}
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("position_id"), F.lit("f").alias("fen"), F.col("toxic").cast("string").alias("model_move"), (F.col("quality") == 1).alias("legal"))
    return rows.withColumns(head)


@query
def record_log(spark, sf_dir):
    """Records numbered, appended as JSON lines in two parts, read back and typed."""
    path = scratch(spark, "records")
    numbered = records.with_event_ids(_label_records(spark, sf_dir), "run_id", F.col("position_id").cast("long"), "legal", "model_move")
    for part in ("legal", "NOT legal"):
        sinks.append_records(numbered.where(part), path)
    return scans.read_records(spark, path).select("record_type", "position_id", "model_move", "legal")


@query
def record_log_file(spark, sf_dir):
    """The same in one growing file, by three commits, one of them a repeated batch that adds nothing."""
    path = scratch(spark, "log") + "/records.jsonl"
    numbered = records.with_event_ids(_label_records(spark, sf_dir), "run_id", F.col("position_id").cast("long"), "legal", "model_move")
    for batch, part in (("first", "legal"), ("second", "NOT legal"), ("second", "NOT legal")):
        record_log_sink.append_records(numbered.where(part), path, batch, "event_id")
    return record_log_sink.read_log(spark, path).select("record_type", "position_id", "model_move", "legal")


@query
def record_stream(spark, sf_dir):
    """Records appended by a stream, whole micro-batches at a time."""
    from .streaming.jobs import append_stream, stream_records

    source, out, marks = (scratch(spark, n) for n in ("log", "stream", "marks"))
    sinks.append_records(records.with_event_ids(_label_records(spark, sf_dir), "run_id", F.col("position_id").cast("long"), "legal"), source)
    append_stream(stream_records(spark, source), out, marks).awaitTermination()
    return spark.read.schema("position_id string, legal boolean").json(out)


@query
def example_stream(spark, sf_dir):
    """Games to examples as a stream."""
    from .streaming.jobs import stream_examples

    source, out, marks = (scratch(spark, n) for n in ("games", "examples", "marks"))
    raw_games(spark, sf_dir).drop("o_orderkey").write.parquet(source)
    stream_examples(spark, source, out, marks).awaitTermination()
    return spark.read.parquet(out).groupBy("elo_bucket", "result", "opening_family", "termination_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("input_ids")).alias("tokens"))


@query
def fen_lines(spark, sf_dir):
    """FEN lines with their places; blank lines count and leave."""
    keys = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    path = f"{scratch(spark, 'fen')}/positions.fen"
    sinks.write_text(spark, path, "".join("  \n" if k % 4 == 3 else f" rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - {k} {k + 1}\n" for k in keys))
    return scans.read_fens(spark, path)


@query
def sequence_lines(spark, sf_dir):
    """Scoring sequences from JSON lines: valid ones, and why others are not; the first 30 (the cap of a run)."""
    path, key = scratch(spark, "sequences"), F.col("item_id")
    side = F.get(F.array(*map(F.lit, ("white", "black", "draw"))), (key % 3).cast("int"))
    moves = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e2e4"), F.lit("e7e5")))
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct(F.concat(F.lit("g"), key).alias("id"), side.alias("perspective"), moves.alias("moves"))).alias("value"))
    lines.repartitionByRange(3, "item_id").sortWithinPartitions("item_id").select("value").write.text(path)
    found = scans.read_sequences(spark, path, 30, quarantine=True)
    return found.select("id", F.size("moves").alias("n"), F.element_at(F.split("_error", ": "), 2).alias("error"))


@query
def score_games(spark, sf_dir):
    """Games that must be in the vocabulary, their scored ids, and one log probability for each but the first."""
    parsed = games.parse_movetext(raw_games(spark, sf_dir).where("o_orderkey % 11 < 9")).withColumn("id", F.col("o_orderkey").cast("string"))
    checked = scoring.check_vocabulary(parsed)
    ids = vocabulary.with_token_ids(checked, scoring.scored_ids(scalar.side_for_turn(F.col("o_orderkey") % 2 == 0), F.col("moves"), F.col("Result") == "1/2-1/2"), vocabulary.token_list())
    scored = scoring.score_sequences(ids.select("o_orderkey", "input_ids"), scoring.UniformScorer)
    return scored.select("o_orderkey", _joined("input_ids").alias("ids"), F.size("token_logprobs").alias("n"), F.round(arrays.array_sum("token_logprobs"), 9).alias("total"))


@query
def legal_predictions(spark, sf_dir):
    """Unmasked choices of the uniform scorer, whose first token is no move, on positions reached by fixed games."""
    from .operators.chess_udfs import fen_after

    parsed = games.parse_movetext(raw_games(spark, sf_dir)).where("moves IS NOT NULL")
    spots = parsed.select(F.col("o_orderkey").cast("string").alias("position_id"), fen_after("moves").alias("fen"), scalar.side_for_turn(F.size("moves") % 2 == 0).alias("perspective"), "moves")
    return scoring.predict_positions(spots, scoring.UniformScorer).select("position_id", "perspective", "model_move", "legal")


@query
def sample_top_k(spark, sf_dir):
    """Draws: greedy, of the best one, and of the best five, which must be among them."""
    scores = F.transform("embedding", lambda x: x.cast("double"))
    drawn = arrays.sample_index(scores, 0.7, 5, F.col("vec_id"))
    best = F.transform(arrays.top_k(scores, 5), lambda p: p["id"])
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.sample_index(scores, 0.0, 0).alias("greedy"), arrays.sample_index(scores, 0.7, 1, F.col("vec_id")).alias("best"), F.array_contains(best, drawn).alias("among_five"))


@query
def illegal_negatives(spark, sf_dir):
    """A move outside a row's legal ones, drawn by hash."""
    every = F.array(*[F.lit(str(k)) for k in range(10)])
    legal = F.transform(F.sequence(F.lit(0), (F.col("l_linenumber") % 4).cast("int")), lambda i: ((i * 3 + F.col("l_partkey")) % 10).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", legal.alias("legal"))
    return rows.select("l_orderkey", "l_linenumber", preferences.illegal_negative(every, "legal", 11, "l_orderkey", "l_linenumber").alias("rejected"))


@query
def pgn_round_trip(spark, sf_dir):
    """Fixed games exported to one PGN file, scanned, and parsed again."""
    from .chess.notation import export_pgn

    known = [(n, u) for n, _, u in MOVETEXTS if u]
    path = f"{scratch(spark, 'pgn')}/games.pgn"
    sinks.write_pgn(spark, path, (export_pgn(u.split(), {"Event": n, "Result": "*"}) for n, u in known))
    rows = scans.read_pgn(spark, path)
    return rows.select("game_id", F.col("headers")["Event"].alias("name"), F.array_join("moves", " ").alias("uci"))


@query
def puzzle_scan(spark, sf_dir):
    """Puzzles of a CSV file by rating and theme."""
    path = scratch(spark, "puzzles")
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("PuzzleId"), F.lit("f").alias("FEN"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("Moves"), (F.col("p_size") * 40).alias("Rating"), F.concat_ws(" ", F.lit("all"), F.substring("p_brand", 7, 1)).alias("Themes"))
    rows.write.option("header", True).csv(path)
    found = scans.read_puzzles(spark, path, (500, 1500), ["1", "3"])
    return found.select(F.col("puzzle_id").cast("long").alias("puzzle_id"), F.array_join("solution", " ").alias("solution"), "rating", F.size("themes").alias("n_themes"))


@query
def vocabulary_file(spark, sf_dir):
    """The vocabulary as a JSON document, written and read."""
    path = sinks.write_vocabulary(spark, list(vocabulary.token_list()), scratch(spark, "vocabulary"), "x")
    text = scans.read_text_document(spark, path).select(F.from_json("value", "map<string,int>").alias("m"))
    return text.select(F.explode("m").alias("token", "id"))


@query
def report_match(spark, sf_dir):
    """The metrics that a run's records and configuration give, by way of the dispatcher."""
    rows = _as_games(spark, sf_dir).withColumns({"record_type": F.lit("per_game"), "phase": F.lit(None).cast("string"), "raw_sample_legal": F.lit(None).cast("boolean")})
    payload = report.compute_all(rows, {"evaluator": "vs_stockfish", "stockfish_skill": 4})
    found = [("overall", "overall", payload["win_rate"]["overall"])] + [("model_side", s, payload["win_rate"]["by_model_side"][s]) for s in C.SIDES]
    return spark.createDataFrame([(d, s, *[x[n] for n in report.WIN], payload["stockfish_skill"]) for d, s, x in found], "dimension string, stratum string, games bigint, wins bigint, losses bigint, draws bigint, unfinished bigint, win_rate double, score_rate double, skill int")


@query
def run_names(spark, sf_dir):
    """Run ids, tags, and the names of games and positions."""
    from datetime import datetime

    tag = runs.resolve_checkpoint_tag("org/some_name")
    run = runs.make_run_id(tag, "legal_rate", datetime(2026, 4, 19, 20, 15, 0))
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    named = keys.select("c_custkey", scalar.game_id("c_custkey").alias("game_id"))
    return named.withColumns({"position_id": scalar.position_id("game_id", F.col("c_custkey") % 90), "run_id": F.lit(run)})


@query
def run_folder(spark, sf_dir):
    """A run's configuration, written and read as a document."""
    run = runs.Run(spark, scratch(spark, "run"))
    run.write_config(runs.config_payload("legal_rate", "r", "c", runs.LegalRateConfig(positions_path="p.fen"), {"temperature": 0.5}))
    return scans.read_json_document(spark, run.path("config.json")).select("evaluator", "run_id", "checkpoint", "positions_path", "temperature")


@query
def game_move_join(spark, sf_dir):
    """Move rows beside their game's."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("ply"))
    ends = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.col("o_orderstatus").alias("result"))
    return metrics.strata_counts(records.with_games(li, ends), "result", "ply")


@query
def balanced_eval(spark, sf_dir):
    """An evaluation set with as many rows of every length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", scalar.game_length(F.expr("n_chars div 100")).alias("length"))
    return sampling.balanced_sample(docs, "length", 40, "doc_id", seed=3)


@query
def time_controls(spark, sf_dir):
    """Games by the kind that their event tells, and by length."""
    parsed = games.parse_movetext(raw_games(spark, sf_dir))
    return metrics.strata_counts(parsed, scalar.time_control("Event").alias("control"), scalar.game_length(F.size("moves")).alias("length"))


@query
def played_games(spark, sf_dir):
    """Twelve short games of the uniform scorer against the first-move player, played by the turn loop."""
    found = evaluate.play_games(spark, scoring.UniformScorer, evaluate.FirstMoveOpponent, runs.MatchConfig(games=12, max_plies=6), "r", "c")
    return found.where("record_type = 'per_game'").select("game_id", "model_side", "result", "termination", "ply_count")
