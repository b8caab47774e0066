from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pawnmill.operators import dictionaries as D


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k int, tokens array<string>, input_ids string")


@pytest.mark.parametrize("chunk", [(4096, 1 << 19), (3, 1000), (4096, 7)])
def test_equals_a_plain_dictionary(spark, monkeypatch, chunk):
    monkeypatch.setattr(D, "CHUNK_ROWS", chunk[0])
    monkeypatch.setattr(D, "CHUNK_VALUES", chunk[1])
    rng = random.Random(1)
    known = {f"t{k}": 1_000_000 + 7 * k for k in range(60)}
    vocab = spark.createDataFrame([*known.items(), (None, 5)], "token string, id int")
    rows = [(k, [rng.choice([f"t{rng.randrange(90)}", "hot", None]) for _ in range(rng.randrange(12))], "own") for k in range(200)] + [(900, None, None), (901, [], "x"), (902, ["hot"] * 5000, "x"), (None, ["t1"], None)]
    df = rows_of(spark, rows).repartition(3)
    found = D.with_token_ids(df, "tokens", vocab)
    assert found.columns == ["k", "tokens", "input_ids"]
    want = {k: None if t is None else [known.get(x, 1) for x in t] for k, t, _ in rows}
    assert {r["k"]: r["input_ids"] for r in found.collect()} == want
    back = D.with_tokens(found, "input_ids", vocab.where("token IS NOT NULL"), out="back")
    assert {r["k"]: r["back"] for r in back.collect()} == {k: None if t is None else [x if x in known else "<UNK>" for x in t] for k, t, _ in rows}


def test_repeated_and_empty_tables(spark):
    vocab = spark.createDataFrame([("a", 4)], "token string, id int")
    df = rows_of(spark, [(1, ["a", "b"], None)] * 50)
    assert [r["input_ids"] for r in D.with_token_ids(df, "tokens", vocab).collect()] == [[4, 1]] * 50
    assert D.with_token_ids(df.limit(0), "tokens", vocab).count() == 0
    assert [r["input_ids"] for r in D.with_token_ids(df.limit(1), "tokens", vocab.limit(0)).collect()] == [[1, 1]]


def test_values_are_joined_by_shuffles_only(spark):
    df = rows_of(spark, [(1, ["a", "b"], None)])
    plan = D.with_token_ids(df, "tokens", spark.createDataFrame([("a", 4)], "token string, id int"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_vocabulary_of_a_column(spark):
    df = rows_of(spark, [(1, ["b", "a", "a", None], None), (2, ["b", "c"], None), (3, None, None)])
    assert sorted(map(tuple, D.build_vocabulary(df, "tokens", first_id=6).collect())) == [("a", 6), ("b", 7), ("c", 8)]
    assert [tuple(r) for r in D.build_vocabulary(df, F.col("tokens"), least=2).collect()] == [("b", 0)]


def test_out_may_take_the_place_of_the_values(spark):
    """Then the values themselves are neither written nor shuffled with the rows."""
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    df = rows_of(spark, [(1, ["a", "b", "c", None], "x"), (2, None, "y")])
    found = D.with_token_ids(df, "tokens", vocab, out="tokens")
    assert found.columns == ["k", "input_ids", "tokens"] and sorted(map(tuple, found.collect())) == [(1, "x", [4, 5, 1, 1]), (2, "y", None)]
    back = D.with_tokens(found, "tokens", vocab, out="tokens")
    assert {r["k"]: r["tokens"] for r in back.collect()} == {1: ["a", "b", "<UNK>", "<UNK>"], 2: None}


@pytest.mark.parametrize("name", ["encode_ids_large", "decode_ids_large"])
def test_large_queries_carry_no_words_beside_the_codes(spark, monkeypatch, name, tmp_path):
    from pawnmill.queries import queries

    seen = []
    monkeypatch.setattr(D, "_encode", lambda rows, kind, plain=D._encode: seen.append(rows.columns) or plain(rows, kind))
    spark.createDataFrame([(k, f"a b c{k}") for k in range(5)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == 5
    assert seen and all(columns == ["doc_id", "__in"] for columns in seen)
