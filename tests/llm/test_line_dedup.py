from __future__ import annotations

import hashlib
import os

import pytest

from pawnmill.llm import line_dedup as L
from tests.llm.helpers import docs, prose


def brute(rows, min_words=L.MIN_WORDS):
    seen, out = {}, {}
    for i, t in sorted(rows):
        spans = []
        for unit, a, b in L.units(t, min_words, L.LINE_WORDS):
            if unit in seen:
                spans.append((a, b))
            seen.setdefault(unit, i)
        out[i] = (len(spans), ",".join(f"{a}:{b}" for a, b in L.merge(spans)), L.cut(t or "", spans))
    return out


def test_against_brute_force(spark):
    passage = ". ".join(prose(12, 900 + k) for k in range(6)) + "."
    rows = [(k, f"{prose(20, k)}. {passage if k % 7 == 3 else prose(30, k + 500)}\n{prose(3, k)}\nThe very common line of all documents.\n{prose(9, k % 5)}") for k in range(60)]
    rows += [(100, None), (101, ""), (102, "one two three four five six\none two three four five six"), (103, passage.upper().replace(" ", "  ")), (104, "\n\n"), (105, "😀 " * 10 + "\n" + "😀 " * 10)]
    found = L.dedup_lines(docs(spark, [(*r, "s", 0) for r in rows], ", removed int"), with_text=True).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_removed"], r["removed"], r["clean_text"]) for r in found} == want and len(found) == len(rows)
    assert all(r["clean_chars"] == len(r["clean_text"]) and r["clean_sha256"] == hashlib.sha256(r["clean_text"].encode()).hexdigest() for r in found)
    assert want[103][2].strip() == ""  # an edited copy of a whole passage
    assert len(want[10][2].split()) < 60 and want[3][0] <= 1  # a later holder loses the passage, the first keeps it


def test_units():
    assert [u for u, _, _ in L.units("a b c d e f. g h i j k l!\nshort one")] == ["a b c d e f. g h i j k l!", "a b c d e f.", "g h i j k l!"]
    text = "One two three  four five six.\nseven eight nine ten eleven twelve"
    assert all(" ".join(text[a:b].lower().split()) == u for u, a, b in L.units(text))


def test_odd_inputs(spark):
    assert L.dedup_lines(docs(spark, [])).count() == 0
    line = "one two three four five six"
    found = L.dedup_lines(docs(spark, [(1, line), (1, line), (None, line), (2, line)])).collect()
    assert sorted((repr(r["doc_id"]), r["n_removed"]) for r in found) == [("1", 0), ("1", 0), ("2", 1), ("None", 1)]


def test_short_lines(spark):
    verse = "\n".join(" ".join(prose(4, 700 + k).split()) for k in range(15))
    rows = [(1, f"{prose(20, 1)}\n{verse}\n"), (2, f"{prose(20, 2)}\nAll rights reserved.\n\n{verse}"), (3, f"all  rights reserved.\n{prose(20, 3)}\nEnd"), (4, "End\n \n\nMr. Fox and all the others. Mr. Fox"), (5, "end")]
    found = {r["doc_id"]: (r["n_removed"], r["removed"], r["clean_text"]) for r in L.dedup_lines(docs(spark, rows), with_text=True).collect()}
    assert found[2][2] == f"{prose(20, 2)}\nAll rights reserved.\n\n" and found[2][0] == 15  # a passage of 60 words in lines of four
    assert found[1][0] == 0 and found[3][2] == f"{prose(20, 3)}\nEnd"
    assert found[4][2] == " \n\nMr. Fox and all the others. Mr. Fox" and found[5] == (1, "0:3", "")  # blank lines and short sentences stay


def test_spans_meet_their_own_text(spark):
    """Null and repeated ids: no text loses what another one of its id repeats."""
    a, b, c = "alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda mu", "own words of the last text only"
    rows = [(1, f"{a}\n{b}"), (None, f"{a}\n{c}"), (None, "quite other words\nin two lines"), (9, f"{b}\nnine"), (9, "occur twice\nanywhere"), (9, "occur twice\nanywhere")]
    df = docs(spark, [(*r, "s", 1, 2, 3) for r in rows], ", start int, `end` int, hash int")
    found = sorted((repr(r["doc_id"]), r["clean_text"], r["n_removed"]) for r in L.dedup_lines(df, with_text=True).collect())
    assert found == sorted([("1", f"{a}\n{b}", 0), ("None", c, 1), ("None", "quite other words\nin two lines", 0), ("9", "nine", 1), ("9", "occur twice\nanywhere", 0), ("9", "occur twice\nanywhere", 0)])


def test_passages(spark):
    passage = "\n".join(prose(20, 50 + k) for k in range(3))
    rows = [(1, f"{passage}\nsome more"), (2, f"begin\n{passage}\nend"), (3, f"{prose(20, 50)}\nanother")]
    found = {r["doc_id"]: (r["n_removed"], r["n_passages"]) for r in L.dedup_lines(docs(spark, rows)).collect()}
    assert found == {1: (0, 0), 2: (3, 1), 3: (1, 0)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op5_exact_dedup", "op8_line_dedup", "op9_source_mixing"])
def test_sql_twins(spark, name):
    import duckdb

    from pawnmill.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    found = con.sql(oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == sorted(repr(tuple(plain(r[k]) for k in at)) for r in found.fetchall())
