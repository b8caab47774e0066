"""Canonical exact fingerprints.

A text is brought to a canonical form (NFKC, case folding, runs of white space to one space,
no outer space) and hashed to 128 bits (XXH3) of its UTF-8 bytes. Texts with equal digests
are grouped and compared byte by byte; in a group whose bytes differ, every fingerprint gets
the SHA-256 of its text as a suffix, so equal fingerprints mean equal canonical texts.

The comparison moves only texts that may share a digest: a map with one bit for each of
2^SLOT_BITS slots of digests (2 MiB, a fixed bound) says which slots hold several rows. On a
corpus that fills every slot all texts take part, with the same result. Least and greatest
bytes of a group are found with map-side partial aggregation, so a group of copies that
holds a third of all rows sends two texts a task.

Likeness of two fingerprints is 1 when they are equal, else 0: an exact digest knows no
degrees.

Documents meet their successors in one range sort by (id descending, text hash). Each task
pairs the rows of its range and hands out its first and last text; the last texts then meet
the first ones of the next range. All of that is read from one stored table, so nothing
hangs on how often, or in how many partitions, the input is computed.

Defined results: null text is empty; the empty text has a fingerprint like others; an empty
table gives no rows; repeated rows have equal fingerprints; rows that repeat an id stand in
the order of their texts' hashes; a null id is the least, so it comes last in descending
order; a single document is its own successor; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, parts, shuffle_partitions, stored, text_or_empty

#: Bits of the map of digest slots that hold several rows (2 MiB, whatever the corpus).
SLOT_BITS = 24


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", text).casefold()
    if not folded.isascii():
        folded = unicodedata.normalize("NFKC", folded)
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest_bytes(raw: bytes, collided: frozenset[str] = frozenset()) -> str:
    out = xxhash.xxh3_128_hexdigest(raw)
    return f"{out}-{hashlib.sha256(raw).hexdigest()}" if out in collided else out


def digest(text: str | None, collided: frozenset[str] = frozenset()) -> str:
    return digest_bytes(canonical(text or ""), collided)


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", collided: list[str] | None = None) -> DataFrame:
    """doc_id, n_chars and digest of every row; no shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()
    apart = frozenset(collided or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([digest(t, apart) for t in texts], pa.string())], names=["doc_id", "n_chars", "digest"]
                )

    return df.select(col(id_col), col(text_col)).mapInArrow(run, f"doc_id {id_type}, n_chars bigint, digest string")


def shared_slots(prints: DataFrame) -> np.ndarray:
    """Bit map, as 64-bit words, of the digest slots that hold more than one row."""
    slot = F.conv(F.substring("digest", 1, SLOT_BITS // 4), 16, 10).cast("int")
    many = prints.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = many.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits"))
    out = np.zeros(1 << (SLOT_BITS - 6), dtype=np.int64)
    found = words.toPandas()  # at most 2^(SLOT_BITS - 6) rows
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def collided_digests(df: DataFrame, prints: DataFrame, text_col: str = "text") -> list[str]:
    """Digests that different canonical texts share, found by comparing bytes; as good as always none."""
    slots = df.sparkSession.sparkContext.broadcast(shared_slots(prints))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = slots.value
        for batch in batches:
            for part in parts(batch, text=0):
                digests, texts = [], []
                for text in part.column(0).to_pylist():
                    raw = canonical(text or "")
                    d = xxhash.xxh3_128_hexdigest(raw)
                    k = int(d[: SLOT_BITS // 4], 16)
                    if int(words[k >> 6]) >> (k & 63) & 1:
                        digests.append(d)
                        texts.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(texts, pa.binary())], names=["digest", "bytes"])

    shared = df.select(col(text_col)).mapInArrow(candidates, "digest string, bytes binary")
    ends = shared.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest"))
    return sorted(r["digest"] for r in ends.where("least <> greatest").select("digest").collect())


def fingerprint_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(fingerprint, group_id: its least doc_id, group_size), and the digests that had to be told apart."""
    prints = materialise(fingerprint_texts(df, id_col, text_col))
    collided = collided_digests(df, prints, text_col)
    if collided:
        prints = fingerprint_texts(df, id_col, text_col, collided)
    groups = prints.groupBy(F.col("digest").alias("fingerprint")).agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return groups, collided


FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _compared(text: str, other: str, apart: frozenset[str]) -> tuple:
    """FIELDS but the first, of a text and the next document's."""
    n = len(text)
    half = n // 2
    edited = text[: n - half] + other[:half]
    mine, its, next_one = canonical(text), canonical(edited), canonical(other)
    a, b, c = (digest_bytes(x, apart) for x in (mine, its, next_one))
    # equal digests count only with equal bytes
    return n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a, b, float(a == b and mine == its), float(a == c and mine == next_one)


def _with_successors(df: DataFrame, id_col: str, text_col: str, apart: frozenset[str]) -> DataFrame:
    """FIELDS of every row of df."""
    id_type = df.schema[id_col].dataType.simpleString()
    fields = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the range but the last, with FIELDS; then its first and its last text."""
        here, first, last, id_arrow = TaskContext.get().partitionId(), None, None, None

        def rows(ids, compared, **edge) -> pa.RecordBatch:
            columns = list(zip(*compared)) or [[]] * len(KINDS)
            n, none = len(ids), lambda v: [v] * len(ids)
            return pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, k) for c, k in zip(columns, KINDS)), pa.array([here] * n, pa.int32()), pa.array(none(edge.get("first")), pa.string()), pa.array(none(edge.get("last")), pa.string())],
                names=[*FIELDS, "range", "first", "last"],
            )

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for part in parts(batch):
                ids, texts = part.column(0), part.column(1).to_pylist()
                found = []
                if first is None:
                    first = texts[0]
                else:
                    found.append(_compared(last[1], texts[0], apart))
                found += [_compared(a, b, apart) for a, b in zip(texts, texts[1:])]
                known = pa.concat_arrays([*([] if last is None else [last[0]]), ids.slice(0, len(ids) - 1)])
                yield rows(known, found)
                last = ids.slice(len(ids) - 1), texts[-1]
        if last is not None:
            yield rows(last[0].cast(id_arrow), [(None,) * len(KINDS)], first=first, last=last[1])

    order = [F.col("id").desc_nulls_last(), F.col("hash"), F.col("tie")]  # equal rows are spread over ranges too
    texts = df.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("hash"), F.monotonically_increasing_id().alias("tie"))
    line = texts.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).select("id", "text")
    out = stored(line.mapInArrow(pair, f"{fields}, range int, first string, last string"))
    # one row, with two texts, for each range that has rows
    ends = out.where("last IS NOT NULL").select("doc_id", "range", "first", "last")
    ranges = sorted(r["range"] for r in ends.select("range").collect())
    after = df.sparkSession.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1])), "this int, following int")
    met = ends.join(after, F.col("range") == F.col("this")).select("doc_id", F.col("last").alias("text"), "following")
    met = met.join(ends.select(F.col("range").alias("following"), F.col("first").alias("next_text")), "following").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = [_compared(a, b, apart) for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), KINDS))], names=FIELDS)

    return out.where("last IS NULL").select(*FIELDS).unionByName(met.mapInArrow(finish, fields))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited text and the next document (descending id, the last to the first); with its group's least id and size."""
    found = materialise(_with_successors(df, id_col, text_col, frozenset()))
    prints = found.select("doc_id", F.col("fingerprint").alias("digest"))
    collided = collided_digests(df, prints, text_col)
    if collided:
        found = materialise(_with_successors(df, id_col, text_col, frozenset(collided)))
    several = found.groupBy(F.col("fingerprint").alias("its")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = materialise(several)  # so that the join's sides are plain shuffles, which Spark can split
    met = found.join(several, F.col("fingerprint") == F.col("its"), "left")
    return met.select(*FIELDS, F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("group_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
