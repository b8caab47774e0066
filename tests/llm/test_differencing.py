from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pawnmill.llm import byte_tokens, differencing
from tests.llm.helpers import DOCS, docs, prose


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_difference_and_level(lengths, k):
    windows = differencing.difference(lengths, k)
    assert len(windows) == k and sorted(i for w in windows for i in w) == list(range(len(lengths)))
    capacity = max(1, -(-sum(lengths) // k))
    cut = differencing.level(windows, lengths, capacity)
    spans = sorted(s for w in cut for s in w)
    assert all(sum(b - a for _, a, b in w) <= capacity for w in cut) and all(b > a for _, a, b in spans)
    for i, n in enumerate(lengths):
        own = [(a, b) for j, a, b in spans if j == i]
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))


def test_opposing_imbalances_cancel():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 1000) for _ in range(2000)]
    sums = [sum(lengths[i] for i in w) for w in differencing.difference(lengths, 100)]
    assert max(sums) - min(sums) <= 2
    five = [8, 7, 6, 5, 4]
    assert sorted(sorted(five[i] for i in w) for w in differencing.difference(five, 2)) == [[4, 5, 7], [6, 8]]  # sums 16 and 14, as by hand


def test_windows_rise_while_one_is_too_full():
    assert len(differencing.fill([6, 6, 6], 10, cut=False)) == 3  # 18 tokens would need 2
    assert [sum(b - a for _, a, b in w) for w in differencing.fill([6, 6, 6], 10, cut=True)] in ([10, 8], [8, 10])


@pytest.mark.parametrize("text", ["", "a", " ", "  a   b \n\n c\t", "It's <|endoftext|> Ünï😀\u0000 100,000 …", "x" * 20_000, "日本語 текст ﬁ  z\u0085", "\r\n \x1c\x1f 'Tis", prose(500, 1)])
def test_ids_are_those_of_the_tokenizers_file(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(byte_tokens.default_path()).encode(text, add_special_tokens=False).ids
    assert byte_tokens.as_ids(byte_tokens.ByteTokenizer(byte_tokens.default_path()).encode(text)).tolist() == want


def check(rows, texts, capacity, cut=True):
    """Every id of every document in one piece; sequences gapless and within the capacity. Gives the lengths of the sequences."""
    tokenizer = byte_tokens.ByteTokenizer(byte_tokens.default_path())
    by, sequences = {}, {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, t in texts:
        raw = tokenizer.encode(t or "") + b"\0\0\0\0"
        want.setdefault((i, len(raw) // 4), []).append(raw)
    assert by.keys() == want.keys()
    for key, pieces in by.items():
        copies = want[key]
        assert sum(r["length"] for r in pieces) == key[1] * len(copies)
        covered = np.zeros(key[1], int)
        for r in pieces:
            a, n = r["start"], r["length"]
            covered[a : a + n] += 1
            assert r["ids_crc32"] in {zlib.crc32(raw[4 * a : 4 * (a + n)]) for raw in copies} and n > 0
        assert (covered == len(copies)).all()
    lengths = []
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
        lengths.append(at)
    return sorted(lengths)


ODD = [(1, prose(700, 1)), (2, None), (3, ""), (4, " \n"), (None, prose(5, 2)), (None, None), (5, "long " * 9000), (6, prose(40, 3)), (6, prose(40, 3)), (6, prose(41, 4)), (2**62, "x" * 50_000), (-1, "Ünï😀\u0000")]


def test_awkward_documents_without_padding(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in ODD], DOCS + ", ids int, `a.b` int").repartition(5)
    rows = differencing.pack_windows(df, group=4).collect()
    lengths = check(rows, ODD, 1024)
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths) and sum(n < 1024 for n in lengths) <= 10
    assert differencing.pack_windows(df.limit(0)).count() == 0


def test_many_tasks_hand_their_rests_on(spark, monkeypatch):
    monkeypatch.setattr(differencing, "ROUND", 2000)
    texts = [(k, prose(k % 150, k)) for k in range(300)]
    rows = differencing.pack_windows(docs(spark, texts).repartition(40), capacity=512, group=3).collect()
    lengths = check(rows, texts, 512)
    assert all(n == 512 or n & (n - 1) == 0 for n in lengths) and sum(n < 512 for n in lengths) <= 9


def test_whole_documents_when_cuts_are_not_wanted(spark):
    texts = [(k, prose(k % 200, k)) for k in range(200)]
    rows = differencing.pack_windows(docs(spark, texts).coalesce(2), cut=False).collect()
    lengths = check(rows, texts, 1024, cut=False)
    assert all(r["start"] % 1024 == 0 for r in rows)
    assert max(lengths) - min(lengths) <= 200 and sum(lengths) >= 0.8 * 1024 * len(lengths)  # near-equal, as they rose in number
    assert differencing.pack_windows(docs(spark, []), cut=False).count() == 0
