from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pawnmill.operators import records as R
from pawnmill.schemas import NULLABLE, RECORDS, record_schema, superset

VALUES = {"string": "x", "int": 3, "boolean": True, "array<string>": ["a"], "array<double>": [-1.5], "array<struct<move:string,logprob:double>>": [{"move": "e2e4", "logprob": -0.5}]}


def sample(kind, **more):
    return {f.name: None if f.name in NULLABLE else VALUES[f.dataType.simpleString()] for f in record_schema(kind).fields} | more


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


@pytest.mark.parametrize("kind", [r[0] for r in RECORDS])
def test_round_trip(spark, kind):
    record = sample(kind)
    decoded = R.decode_records(lines(spark, record, "", "  "))
    rows = decoded.collect()
    assert [r["record_type"] for r in rows] == [kind]
    assert json.loads(R.encode_records(decoded).first()["value"]) == record


def test_keys_are_disjoint():
    keys = [r[1] for r in RECORDS]
    for kind, key, _ in RECORDS:
        names = {f.name for f in record_schema(kind).fields}
        assert [k for k in keys if k in names] == [key]


def test_missing_nullable_key_and_unknown_type(spark):
    short = sample("per_move")
    del short["is_blunder"]
    for bad in (short, {"foo": 1}, "not json"):
        with pytest.raises(Exception, match="invalid record"):
            R.decode_records(lines(spark, bad)).collect()
    assert R.decode_records(lines(spark, {"foo": 1}), strict=False).first()["record_type"] == "invalid"


def test_infinite_logprob(spark):
    text = json.dumps(sample("per_perplexity")).replace("-1.5", "-Infinity")
    row = R.decode_records(lines(spark, text)).first()
    assert row["record_type"] == "per_perplexity" and row["token_logprobs"] == [float("-inf")]


def test_event_ids_and_prior(spark):
    df = spark.createDataFrame([("r", "g0", 0, "a"), ("r", "g0", 1, "b"), ("r", "g1", 0, "c")], "run string, game string, ply int, move string")
    rows = R.with_prior(R.with_event_ids(df, "run", "game", "ply"), "move", "game", "ply", "prior").orderBy("event_id").collect()
    assert [(r["event_id"], r["prior"]) for r in rows] == [(0, None), (1, "a"), (2, None)]


def test_superset_has_every_field():
    names = {f.name for f in superset().fields}
    assert all(f.name in names for _, _, s in RECORDS for f in s.fields)


def test_key_order(spark):
    keys = spark.createDataFrame([(["legal", "ply"],), (["result", "token_logprobs"],)], "k array<string>")
    assert [r[0] for r in keys.select(R.record_type_of_keys(F.col("k"))).collect()] == ["per_move", "per_game"]


def test_event_ids_by_ranges(spark):
    rows = [("big", k % 977, "x") for k in range(3000)] + [("small", k, "y") for k in range(5)]
    df = spark.createDataFrame(rows, "run string, k int, v string").repartition(9)
    found = R.with_event_ids(df, "run", "k").collect()
    for run, n in (("big", 3000), ("small", 5)):
        own = sorted((r["event_id"], r["k"]) for r in found if r["run"] == run)
        assert [e for e, _ in own] == list(range(n)) and [k for _, k in own] == sorted(k for _, k in own)
    assert R.with_event_ids(spark.createDataFrame([], "run string, k int"), "run", "k").count() == 0


def test_odd_lines(spark):
    """Repeated keys, other JSON values, null values of telling keys, and values of another type."""
    found = R.decode_records(lines(spark, '{"legal": null, "fen": "f"}', "[1, 2]", '"text"', '{"legal": true, "fen": "a", "fen": "b"}', '{"ply": "x", "phase": 5}', "{}", "{broken"), strict=False).collect()
    assert [r["record_type"] for r in found] == ["per_legal_rate", "invalid", "invalid", "per_legal_rate", "per_move", "invalid", "invalid"]
    assert found[0]["fen"] == "f" and found[0]["legal"] is None and found[4]["ply"] is None and found[4]["phase"] == "5"


def test_lines_are_parsed_once(spark):
    plan = R.decode_records(lines(spark, "{}"), strict=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "json_object_keys" not in plan
