from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from pawnmill.sources import record_log as L

HEAD = {"run_id": "r", "evaluator": "legal_rate", "checkpoint": "c", "record_type": "per_legal_rate", "fen": "f", "model_move": "e2e4"}


def records(spark, first, n):
    return spark.range(first, first + n, 1, 4).select(F.col("id").cast("int").alias("event_id"), F.col("id").cast("string").alias("position_id"), (F.col("id") % 2 == 0).alias("legal"), *[F.lit(v).alias(k) for k, v in HEAD.items()])


def ids(path):
    with open(path) as f:
        return [json.loads(line)["event_id"] for line in f]


def test_batches_append_in_order_and_once(spark, tmp_path):
    path = str(tmp_path / "records.jsonl")
    L.append_records(records(spark, 0, 50), path, "a", "event_id")
    L.append_records(records(spark, 50, 30), path, "b", "event_id")
    L.append_records(records(spark, 50, 30), path, "b", "event_id")  # again: adds nothing
    assert ids(path) == list(range(80)) and L.committed_length(path) == os.path.getsize(path)
    assert os.listdir(path + ".staging") == []
    L.append_records(records(spark, 0, 0), path, "empty")
    L.append_records(records(spark, 80, 1), "file://" + path, "c")
    assert ids(path) == list(range(81))
    rows = L.read_log(spark, path).collect()
    assert sorted(r["event_id"] for r in rows) == list(range(81)) and {r["record_type"] for r in rows} == {"per_legal_rate"}


def test_a_killed_commit_leaves_a_valid_prefix(spark, tmp_path):
    path = str(tmp_path / "records.jsonl")
    L.append_records(records(spark, 0, 20), path, "a", "event_id")
    with open(path, "ab") as f:
        f.write(b'{"run_id":"r","event_id":77,"half')  # killed while appending
    with open(path + ".commits", "ab") as f:
        f.write(b'{"batch": "b", "le')  # or while noting it
    assert sorted(r["event_id"] for r in L.read_log(spark, path).collect()) == list(range(20))
    L.append_records(records(spark, 20, 5), path, "b", "event_id")
    assert ids(path) == list(range(25)) and [c["batch"] for c in L._commits(path)] == ["a", "b"]


def test_a_failing_task_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "records.jsonl")
    L.append_records(records(spark, 0, 8), path, "a")
    bad = records(spark, 8, 8).withColumn("model_move", F.when(F.col("event_id") == 15, F.raise_error(F.lit("boom")).cast("string")).otherwise("x"))
    with pytest.raises(Exception, match="boom"):
        L.append_records(bad, path, "b")
    assert sorted(ids(path)) == list(range(8))
    L.append_records(records(spark, 8, 8), path, "b")
    assert sorted(ids(path)) == list(range(16))
    L.sweep_staging(path)
    assert os.listdir(path + ".staging") == []


@pytest.mark.parametrize("piece", [7, 100, 10_000])
def test_prefix_lines_in_byte_ranges(spark, tmp_path, piece):
    path = str(tmp_path / "lines")
    lines = ["", "a", "ü" * 30, "b" * 200, "", "end"]
    data = "".join(x + "\n" for x in lines).encode()
    with open(path, "wb") as f:
        f.write(data + b"torn")
    assert sorted(r["value"] for r in L._prefix_lines(spark, path, len(data), piece).collect()) == sorted(lines)
    assert [r["value"] for r in L._prefix_lines(spark, path, 0, piece).collect()] == []


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    source, path, marks = (str(tmp_path / n) for n in ("in", "records.jsonl", "marks"))
    schema = records(spark, 0, 1).schema
    for k in range(3):
        records(spark, 10 * k, 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    L.append_stream(stream(), path, marks, "run").awaitTermination()
    assert sorted(ids(path)) == list(range(30)) and len(L._commits(path)) == 3
    # the last commit's mark is lost: Spark runs that batch again, and the log has it already
    last = max(int(f) for f in os.listdir(marks + "/commits") if f.isdigit())
    for f in os.listdir(marks + "/commits"):
        if str(last) in f:
            os.remove(f"{marks}/commits/{f}")
    records(spark, 30, 5).coalesce(1).write.mode("append").parquet(source)
    L.append_stream(stream(), path, marks, "run").awaitTermination()
    assert sorted(ids(path)) == list(range(35))
