from __future__ import annotations

from pyspark.sql import functions as F

from pawnmill import constants as C
from pawnmill.operators import vocabulary as V


def test_columns_and_driver_agree(spark):
    rows = V.vocabulary(spark).orderBy("id").collect()
    assert [r["token"] for r in rows] == list(V.token_list())
    assert [r["id"] for r in rows] == list(range(C.VOCABULARY_SIZE))


def test_content():
    tokens = V.token_list()
    assert tokens[:6] == ("<PAD>", "<UNK>", "<EOS>", "<WHITE>", "<BLACK>", "<DRAW>")
    assert all(t in tokens for t in ("e2e4", "e4f6", "e7e8q", "a7b8q", "h7g8n", "e2e1q", "d2c1n"))
    assert not any(t in tokens for t in ("e4e4", "a1c4", "a1d3"))
    assert (tokens.index("a1a2"), tokens.index("e2e4"), tokens.index("e7e8q")) == (6, 941, 1904)


def test_tokenizer():
    t = V.Tokenizer()
    assert len(t) == t.vocab_size == 1974
    ids = t.encode("<WHITE> e2e4 e7e5 <EOS>")
    assert (len(ids), ids[0], ids[-1]) == (4, 3, 2)
    assert t.decode(ids) == "<WHITE> e2e4 e7e5 <EOS>"
    assert t.encode("invalid_move") == [1] and t.decode([9999]) == "<UNK>"
    copy = t.get_vocab()
    copy.clear()
    assert t.get_vocab()


def test_encoding_of_columns(spark):
    df = spark.createDataFrame([(1, ["<WHITE>", "e2e4", "zz"]), (2, []), (3, None)], "id int, tokens array<string>")
    out = {r["id"]: r["input_ids"] for r in V.with_token_ids(df, "tokens", V.token_list()).collect()}
    assert out == {1: [3, 941, 1], 2: [], 3: None}
    back = V.with_tokens(V.with_token_ids(df, "tokens", V.vocabulary(spark)), "input_ids", V.token_list(), out="back")
    assert {r["id"]: r["back"] for r in back.collect()} == {1: ["<WHITE>", "e2e4", "<UNK>"], 2: [], 3: None}


def test_encode_text(spark):
    df = spark.createDataFrame([("  <WHITE> e2e4\n<EOS> ",), ("",)], "t string")
    rows = V.encode_text(df, "t", V.token_list()).orderBy(F.desc("t")).collect()
    assert sorted((r["input_ids"], r["attention_mask"]) for r in rows) == [([], []), ([3, 941, 2], [1, 1, 1])]


def test_vocabulary_json(spark):
    import json

    assert json.loads(V.vocabulary_json(V.vocabulary(spark)))["e2e4"] == 941


def test_decoding_of_columns(spark):
    df = spark.createDataFrame([(1, [0, 2, 99, -1]), (2, []), (3, None)], "k int, ids array<int>")
    found = {r["k"]: r["tokens"] for r in V.with_tokens(df, "ids", ["a", "b", "c"]).collect()}
    assert found == {1: ["a", "c", "<UNK>", "<UNK>"], 2: [], 3: None}
