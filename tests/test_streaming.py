from __future__ import annotations

from pawnmill.streaming import jobs
from tests.test_games import raw


def test_examples_stream_twice(spark, tmp_path):
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    raw(spark, {}, {"Result": "1/2-1/2"}, {"Event": "Bullet"}).write.parquet(source)
    jobs.stream_examples(spark, source, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    raw(spark, {}).write.mode("append").parquet(source)
    jobs.stream_examples(spark, source, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_running_counts(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"run_id":"r","event_id":0,"evaluator":"vs_stockfish","checkpoint":"c","game_id":"g","model_side":"white","result":"1-0","termination":"natural","ply_count":9}\n')
    counts = jobs.running_win_counts(jobs.stream_records(spark, str(folder)))
    query = counts.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("wins").collect()] == [("white", "1-0", 1)]


def turns(spark):
    rows = [("g", 0, [3], False), ("g", 1, [3, 7], False), ("g", 2, [3, 8], False), ("g", 3, [3, 8, 9], True), ("g", 4, [3, 8, 9, 1], False), ("h", 0, [4, 5], False)]
    return spark.createDataFrame(rows, "game_id string, ply int, input_ids array<int>, ended boolean")


WANT = {("g", 0, 1, 0), ("g", 1, 2, 1), ("g", 2, 2, 0), ("g", 3, 3, 2), ("g", 4, 4, 0), ("h", 0, 2, 0)}


def test_prefix_reuse_batch(spark):
    assert {tuple(r) for r in jobs.prefix_reuse_batch(turns(spark)).collect()} == WANT


def test_prefix_reuse_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    turns(spark).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(turns(spark).schema).parquet(source)
    query = jobs.prefix_reuse(stream).writeStream.format("memory").queryName("reuse").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("reuse").collect()} == WANT


def random_turns(spark, n=400):
    """Games whose lines extend, repeat, cut or change the one before, some of them null or empty."""
    import random

    rng, rows = random.Random(8), []
    for game in range(12):
        line = []
        for ply in range(n // 12 * (4 if game == 0 else 1)):
            step = rng.randrange(8)
            line = line[: rng.randrange(len(line) + 1)] if step == 0 else [*line[:-1], 9] if step == 1 and line else line if step == 2 else [*line, rng.randrange(3)]
            rows.append((f"g{game}" if game else None, ply, None if step == 3 and not line else list(line), rng.random() < 0.1))
    return rows


def reused(rows):
    known, out = {}, []
    for game, ply, tokens, ended in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        tokens, prior = tokens or [], known.get(game, [])
        out.append((game, ply, len(tokens), len(prior) if len(prior) < len(tokens) and tokens[: len(prior)] == prior else 0))
        known[game] = [] if ended else tokens
    return sorted(out, key=repr)


def test_prefix_reuse_batch_and_stream_agree(spark, tmp_path):
    rows = random_turns(spark)
    df = spark.createDataFrame(rows, turns(spark).schema)
    batch = jobs.prefix_reuse_batch(df.repartition(5))
    assert sorted((tuple(r) for r in batch.collect()), key=repr) == reused(rows)
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    # three micro-batches, of ascending plies
    source = str(tmp_path / "in")
    named = [r for r in rows if r[0]]
    for k, (a, b) in enumerate([(0, 9), (9, 10), (10, 1000)]):
        spark.createDataFrame([r for r in named if a <= r[1] < b], df.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.prefix_reuse(stream).writeStream.format("memory").queryName("reuse_long").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((tuple(r) for r in spark.table("reuse_long").collect()), key=repr) == reused(named)


def test_rolling_prefixes_tell_places_apart():
    import numpy as np

    seen = {tuple(jobs.rolling_prefix(np.array(t))[-1]) for t in ([1, 2], [2, 1], [1, 1], [2, 2], [1], [1, 2, 0], [-1, 2], [])}
    assert len(seen) == 8


def test_append_stream(spark, tmp_path):
    """Records appended by a stream appear once, also when it is started again."""
    source, out, marks = (str(tmp_path / n) for n in ("log", "out", "marks"))
    line = '{"run_id":"r","event_id":%d,"evaluator":"legal_rate","checkpoint":"c","position_id":"p%d","fen":"f","model_move":"e2e4","legal":true}'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(line % (k, k) for k in range(3)))
    for n in (3, 3, 4):
        if n == 4:
            (tmp_path / "log" / "b.jsonl").write_text(line % (9, 9))
        jobs.append_stream(jobs.stream_records(spark, source), out, marks).awaitTermination()
        rows = spark.read.schema("position_id string, sf_best_move string, legal boolean").json(out).collect()
        assert len(rows) == n and all(r["legal"] for r in rows)


def test_numbers_without_gaps_over_restarts(spark, tmp_path):
    source, marks, out = (str(tmp_path / n) for n in ("in", "marks", "out"))
    schema = "run_id string, nth long, value string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(limit=None, name=""):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        numbered = jobs.numbered_events(stream, limit)
        numbered.writeStream.format("parquet").option("path", out + name).option("checkpointLocation", marks + name).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("run_id string, event_id long, value string").parquet(out + name).collect())

    add([("a", 2, "a2"), ("a", 1, "a1"), ("b", 1, "b1")])
    add([("a", 3, "a3")])
    assert run() == [("a", 0, "a1"), ("a", 1, "a2"), ("a", 2, "a3"), ("b", 0, "b1")]
    add([("b", 3, "b3"), ("b", 2, "b2"), ("c", 1, "c1")])
    assert run() == [("a", 0, "a1"), ("a", 1, "a2"), ("a", 2, "a3"), ("b", 0, "b1"), ("b", 1, "b2"), ("b", 2, "b3"), ("c", 0, "c1")]
    assert [(r, e) for r, e, _ in run(2, "-limited")] == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)]
