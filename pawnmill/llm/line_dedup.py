"""Substring deduplication by lines and the sentences of lines.

A text is cut into lines, and a line of several sentences also into those. Units are
normalised (lower case, white space to one space, none outside) and hashed (XXH3, 128 bits);
digests are grouped over all documents. The occurrence in the document with the least id,
and in it the first, stays; every other occurrence is removed, and its place in the original
text (code points, end exclusive) is kept as a span. A removed line takes its line break
along. Every line with a word in it is a unit, however short; sentences inside a line are
units from MIN_WORDS words (shorter ones, "Mr." or "e.g." among them, are no passages).

Texts are hashed once; the units (digest, document, place) are written as Parquet and all
else reads those. Only a document's first occurrence of a unit takes part in the global
grouping (repeats inside a document need no shuffle), and only least documents and counts
are shuffled for it, with map-side partial aggregation, so a line that a third of all
documents hold costs one row a task. Rows of repeated digests then meet their least document
in a join whose sides are plain shuffles, which Spark splits where one digest is hot.

A document is named by its id and a hash and the length of its text, so spans can only meet
the text that they were cut from, whatever ids repeat or are null.

Defined results: null text is empty and has no units; an empty table gives no rows; rows
that repeat an id with another text are documents of their own (ranked by the text's hash);
rows that repeat both id and text are one document and lose the same spans; a null id comes
after all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, parts, same, stored, text_or_empty

MIN_WORDS, LINE_WORDS = 6, 1
#: Words of a removed run from which it is reported as a passage: a repeated passage of 50 words or more, whose ends share
#: sentences with other text, loses some half of itself at least.
PASSAGE_WORDS = 25
SENTENCE = re.compile(r"[^.!?]*[.!?]+[ \t]*|[^.!?]+\Z")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def units(text: str | None, min_words: int = MIN_WORDS, line_words: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(normalised unit, start, end) of every line of line_words (min_words unless given) and sentence of min_words or more."""
    line_words = min_words if line_words is None else line_words
    at = 0
    lines = (text or "").split("\n")
    for k, line in enumerate(lines):
        plain = SPACES.sub(" ", line.lower()).strip(" ")
        n_words = plain.count(" ") + 1 if plain else 0
        if n_words and n_words >= line_words:
            yield plain, at, at + len(line) + (k < len(lines) - 1)
        if n_words and n_words >= min_words:
            sentences = SENTENCE.findall(line)
            if len(sentences) > 1:
                start = at
                for s in sentences:
                    one = SPACES.sub(" ", s.lower()).strip(" ")
                    if one and one.count(" ") + 1 >= min_words:
                        yield one, start, start + len(s)
                    start += len(s)
        at += len(line) + 1


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in merge(spans):
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def _mark(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.struct(F.xxhash64(text_or_empty(text_col)).alias("hash"), F.length(text_or_empty(text_col)).alias("n"))


def unit_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """h1, h2, doc (none, id, hash, n), start, end and again (an earlier unit of the document has this digest)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                owner, raw, start, end, again = [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    seen: set[bytes] = set()
                    for unit, a, b in units(text, min_words, line_words):
                        d = xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass"))
                        owner.append(k)
                        raw.append(d)
                        start.append(a)
                        end.append(b)
                        again.append(d in seen)
                        seen.add(d)
                h = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
                rows = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *(part.column(c).take(rows) for c in (0, 2, 3)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(again, pa.bool_())],
                    names=["h1", "h2", "id", "hash", "n", "start", "end", "again"],
                )

    texts = df.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text"), _mark(text_col).alias("mark")).select("id", "text", "mark.*")
    return texts.mapInArrow(run, f"h1 bigint, h2 bigint, id {id_type}, hash bigint, n int, start int, end int, again boolean")


def repeated_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """id, hash, n (the document), start, end, keep_id for every occurrence that is removed."""
    table = stored(unit_table(df, id_col, text_col, min_words, line_words))
    firsts = table.where("NOT again")
    ranked = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "n")
    groups = materialise(firsts.groupBy("h1", "h2").agg(F.min(ranked).alias("keep"), F.count(F.lit(1)).alias("documents")).where("documents > 1").select("h1", "h2", "keep"))
    # repeated rows are counted as documents, too, but equal the one that keeps
    own = same(F.col("id"), F.col("keep.id")) & (F.col("hash") == F.col("keep.hash")) & (F.col("n") == F.col("keep.n"))
    elsewhere = firsts.join(groups, ["h1", "h2"]).where(~own).select("id", "hash", "n", "start", "end", F.col("keep.id").alias("keep_id"))
    inside = table.where("again").select("id", "hash", "n", "start", "end", F.col("id").alias("keep_id"))
    return elsewhere.unionByName(inside)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, with_text: bool = False, line_words: int = LINE_WORDS) -> DataFrame:
    """For every row of df: doc_id, n_removed (units), n_passages (merged spans of PASSAGE_WORDS or more), removed (merged spans), clean_chars, clean_sha256, and the clean text if asked for."""
    id_type = df.schema[id_col].dataType.simpleString()
    removed = materialise(
        repeated_units(df, id_col, text_col, min_words, line_words)
        .groupBy("id", "hash", "n")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
        .select("id", "hash", "n", "spans.start", "spans.end")
    )
    texts = df.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), _mark(text_col).alias("mark"))
    its = same(texts["doc_id"], removed["id"]) & (F.col("mark.hash") == removed["hash"]) & (F.col("mark.n") == removed["n"])
    met = texts.join(removed, its, "left").select("doc_id", "text", "start", "end")
    names = ["doc_id", "n_removed", "n_passages", "removed", "clean_chars", "clean_sha256", *(["clean_text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                out: list[list] = [[] for _ in range(6)]
                for text, start, end in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    spans = list(zip(start or (), end or ()))
                    whole = merge(spans)
                    clean = cut(text, spans)
                    passages = sum(len(WORD.findall(text[a:b])) >= PASSAGE_WORDS for a, b in whole)
                    row = [len(spans), passages, ",".join(f"{a}:{b}" for a, b in whole), len(clean), hashlib.sha256(clean.encode("utf-8", "surrogatepass")).hexdigest(), clean]
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in list(zip(out, kinds))[: len(names) - 1])], names=names)

    kinds = {"doc_id": id_type, "n_removed": "bigint", "n_passages": "bigint", "clean_chars": "bigint"}
    return met.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
