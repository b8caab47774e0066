"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Unplaced pieces and the gaps of open sequences are rows of one table. A round

1. range-sorts both by size, the largest first (ranges are cut by size, kind and name, so
   pieces of one length are spread over as many ranges as they need);
2. sweeps every range in its own task: each piece, in descending order, takes the least gap
   of the range that holds it (its successor), and the gap, updated, goes on to the next;
3. settles conflicts between ranges by rank: the pieces that a range could not place claim the
   least gaps that larger ranges have left untouched, as many as surely hold them, as brackets
   match in a row; only counts by range decide who gets which ranks, and the claimed gaps are
   dealt to the range of the claiming pieces, which is swept again;
4. hands what is left, and the updated gaps, to the next round.

A round that places nothing shows that no piece fits any gap. Then new sequences open for the
largest pieces, by rank: as many as the tokens left need at least, or one for each piece over
half the capacity if those are more; no packing of these pieces could do with fewer. Packing
ends when no piece is left. There is a range for every few shuffle partitions, fewer where they
would hold less than LEAST_RANGE_ROWS rows, more where they would hold more than RANGE_ROWS; in
a single range, a sweep is sequential best fit in descending order (tested), and the opening
follows at once.

The driver sees a few counts for each range, and no piece or gap.

Defined results: null text is empty, one end token; an empty table gives no rows; repeated
rows are packed once each; a null id is packed like any other; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, parts, shuffle_partitions, sole_cache, stored
from .tokens import default_path, worker_tokenizer

CAPACITY, END_ID = 4096, 1
#: Rows (pieces and gaps) that one range holds, at most about and, if there is more than one, at least about.
RANGE_ROWS, LEAST_RANGE_ROWS = 200_000, 5_000
#: Shuffle partitions for each range: a sweep is a short task, so there may be fewer of them than of others.
PARTITIONS_A_RANGE = 4
#: Longest table of claims or quotas (two rows a range at most) that is broadcast.
SMALL = 100_000
#: Kinds of rows. Gaps sort before pieces of equal size.
GAP, PIECE, PLACED = 0, 1, 2
SWEPT = "at int, kind int, name bigint, size bigint, sequence_id bigint, offset bigint, nth bigint"


def tokenise_pieces(df: DataFrame, capacity: int, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """tag (a number for the piece), doc_id, piece, start, length, ids_crc32: documents cut only where longer than capacity."""
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity
    id_type = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(tokenizer_path)
        tag = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in parts(batch):
                ids = part.column(0)
                owner, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(tokenizer.encode_batch([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), width)):
                        chunk = raw[a : a + width]
                        owner.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(chunk) // 4)
                        crc.append(zlib.crc32(chunk))
                tags = np.arange(tag, tag + len(owner), dtype=np.int64)
                tag += len(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tags), ids.take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["tag", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return df.select(col(id_col), col(text_col)).mapInArrow(cut, f"tag bigint, doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Gaps:
    """Open sequences by free space."""

    def __init__(self) -> None:
        self.by_size: dict[int, list[np.ndarray]] = {}
        self.sizes: list[int] = []

    def add(self, size: int, sequences: np.ndarray) -> None:
        if size > 0 and len(sequences):
            if size not in self.by_size:
                self.by_size[size] = []
                insort(self.sizes, size)
            self.by_size[size].append(sequences)

    def take_successor(self, size: int) -> tuple[int, list[np.ndarray]] | None:
        """The least size that holds ``size``, and all its sequences."""
        k = bisect_left(self.sizes, size)
        return None if k == len(self.sizes) else (found := self.sizes.pop(k), self.by_size.pop(found))


def best_fit(pieces: dict[int, np.ndarray], gaps: Gaps, capacity: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sequential best fit, the longest pieces first: (length, pieces, sequences, offsets) of what finds a place.

    ``pieces`` (names by length) is left with the others, and ``gaps`` are updated.
    """
    for length in sorted(pieces, reverse=True):
        names = pieces.pop(length)
        while len(names) and (least := gaps.take_successor(length)):
            size, lots = least
            each = size // length
            for sequences in lots:
                use = min(len(sequences), -(-len(names) // each))
                took = min(len(names), use * each)
                nth = np.arange(took)
                if took:
                    yield length, names[:took], sequences[nth // each], capacity - size + nth % each * length
                full, some = divmod(took, each)
                gaps.add(size - each * length, sequences[:full])
                gaps.add(size - some * length, sequences[full:use])
                gaps.add(size, sequences[use:])
                names = names[took:]
        if len(names):
            pieces[length] = names


def _by_size(sizes: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.lexsort((names, sizes))
    found, at = np.unique(sizes[order], return_index=True)
    return zip(found.tolist(), np.split(names[order], at[1:]))


def _swept(at: int, kind: np.ndarray, name: np.ndarray, size: np.ndarray, capacity: int) -> pa.RecordBatch:
    """One range after its sweep. What is left is numbered: pieces from the largest, gaps from the least.

    Gaps that the sweep has made smaller than the range's sizes have no number (-1).
    """
    least = int(size.min())
    gaps, pieces = Gaps(), dict(_by_size(size[kind == PIECE], name[kind == PIECE]))
    for free, sequences in _by_size(size[kind == GAP], name[kind == GAP]):
        gaps.add(free, sequences)
    rows = [(PLACED, names, np.full(len(names), length), sequences, offsets) for length, names, sequences, offsets in best_fit(pieces, gaps, capacity)]
    none = lambda names: np.full(len(names), -1)
    left = [(PIECE, pieces[length], length) for length in sorted(pieces, reverse=True)] + [(GAP, s, free) for free in gaps.sizes for s in gaps.by_size[free]]
    rows += [(k, names, np.full(len(names), n), none(names), none(names)) for k, names, n in left]
    kinds = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int32)
    nth, sizes = np.full(len(kinds), -1, dtype=np.int64), np.repeat([r[2][0] if len(r[1]) else 0 for r in rows], [len(r[1]) for r in rows])
    for some in (kinds == PIECE, (kinds == GAP) & (sizes >= least)):
        nth[some] = np.arange(int(some.sum()))
    flat = [np.concatenate([r[c] for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64) for c in (1, 2, 3, 4)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), at, np.int32)), pa.array(kinds), *map(pa.array, flat), pa.array(nth)], names=[f.split()[0] for f in SWEPT.split(", ")])


def sweep(rows: DataFrame, capacity: int, dealt: bool) -> DataFrame:
    """SWEPT rows of (at, kind, name, size) after the sweep of each range; ``dealt``: ranges are by at, else a task is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("sweep", lambda: None)  # the token cache has done its work
        held: list[list[np.ndarray]] = []
        at = -1 if dealt else TaskContext.get().partitionId()
        close = lambda: _swept(at, *(np.concatenate(c) for c in zip(*held)), capacity)
        for batch in batches:
            own, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(own)) + 1 if dealt else np.empty(0, int)
            for a, b in zip([0, *cuts], [*cuts, len(own)]):
                if a < b and dealt and own[a] != at:
                    if held:
                        yield close()
                    held, at = [], int(own[a])
                if a < b:
                    held.append([c[a:b] for c in rest])
        if held:
            yield close()

    return rows.select("at", "kind", "name", "size").mapInArrow(run, SWEPT)


def claims(gaps: dict[int, tuple[int, int]], pieces: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(from, first, last, to): the gaps of these ranks of range ``from`` go to range ``to``.

    Of each range: how many gaps and the least of them, how many pieces and the largest.
    Ranges are numbered from the largest sizes on. Each one claims gaps for its pieces, of the
    nearest larger range first and of that the least ones.
    """
    out, left, first = [], [], {}
    for at in sorted(gaps.keys() | pieces.keys()):
        need, largest = pieces.get(at, (0, 1))
        while need > 0 and left:
            source = left[-1]
            n, least = gaps[source]
            begin, each = first.get(source, 0), max(1, least // largest)
            take = min(-(-need // each), n - begin)
            out.append((source, begin, begin + take, at))
            first[source] = begin + take
            need -= take * each
            if first[source] == n:
                left.pop()
        if gaps.get(at, (0, 0))[0]:
            left.append(at)
    return out


def place(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, least_rows: int = LEAST_RANGE_ROWS) -> DataFrame:
    """tag, sequence_id, offset for every row (tag, length) of items; lengths are 1 to capacity."""
    spark = items.sparkSession

    def table(rows: list, schema: str) -> DataFrame:
        out = spark.createDataFrame(rows, schema)
        return F.broadcast(out) if len(rows) <= SMALL else out

    union = lambda frames: reduce(DataFrame.unionByName, frames)
    piece_rows = items.select(F.lit(PIECE).alias("kind"), F.col("tag").alias("name"), F.col("length").cast("long").alias("size"))
    placed = [spark.createDataFrame([], "tag bigint, sequence_id bigint, offset bigint")]
    found = lambda df: df.where(F.col("kind") == PLACED).select(F.col("name").alias("tag"), "sequence_id", "offset")
    left = lambda df: df.where(F.col("kind") != PLACED).select("kind", "name", "size")
    rows, n_rows, opened = piece_rows, items.count(), 0
    while n_rows:
        order = [F.col("size").desc(), F.col("kind"), F.col("name")]
        ranges = rows.select(F.lit(0).alias("at"), "kind", "name", "size")
        # ranges by the parallelism, more where they would grow large; one where there are only few rows
        n_ranges = max(-(-n_rows // range_rows), min(-(-shuffle_partitions(spark) // PARTITIONS_A_RANGE), n_rows // least_rows), 1)
        ranges = ranges.repartitionByRange(n_ranges, *order) if n_ranges > 1 else ranges.coalesce(1)
        swept = materialise(sweep(ranges, capacity, dealt=False))
        wide = F.count_if(F.col("size") * 2 > capacity)
        open_gap = (F.col("kind") == GAP) & (F.col("nth") >= 0)
        figures = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"), wide.alias("wide"), F.max("size").alias("largest"), F.count_if(open_gap).alias("open"), F.min(F.when(open_gap, F.col("size"))).alias("least")]
        counts = {(r["at"], r["kind"]): r for r in swept.groupBy("at", "kind").agg(*figures).collect()}
        by = {k: {at: r["n"] for (at, kind), r in counts.items() if kind == k} for k in (GAP, PIECE, PLACED)}
        placed.append(found(swept))
        if not by[PIECE]:
            break
        rows, n_placed, n_rows = left(swept), sum(by[PLACED].values()), sum(by[GAP].values()) + sum(by[PIECE].values())
        offers = {at: (r["open"], r["least"]) for (at, kind), r in counts.items() if kind == GAP and r["open"]}
        if moves := claims(offers, {at: (n, counts[at, PIECE]["largest"]) for at, n in by[PIECE].items()}):
            goes = table(moves, "source int, first bigint, last bigint, to int")
            mine = (F.col("at") == F.col("source")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("last"))
            sides = swept.where(F.col("kind") == GAP).join(goes, mine, "left").select("to", "kind", "name", "size")
            claiming = F.when(F.col("at").isin(sorted({m[3] for m in moves})), F.col("at"))  # a mark by range, which takes no join
            pieces = swept.where(F.col("kind") == PIECE).select(claiming.alias("to"), "kind", "name", "size")
            dealt = sides.unionByName(pieces)
            met = dealt.where("to IS NOT NULL").withColumnRenamed("to", "at").repartition(len({m[3] for m in moves}), "at").sortWithinPartitions("at")
            again = materialise(sweep(met, capacity, dealt=True))
            more = again.where(F.col("kind") == PLACED).count()
            if more:
                placed.append(found(again))
                n_placed, n_rows = n_placed + more, n_rows - more
                rows = dealt.where("to IS NULL").select("kind", "name", "size").unionByName(left(again))
        one_range = len({at for at, _ in counts}) == 1
        if n_placed and not one_range:
            continue
        # nothing that is left fits a gap: open sequences for the largest, by rank
        own = {at: counts[at, PIECE] for at in by[PIECE]}
        n = max(-(-sum(r["tokens"] for r in own.values()) // capacity), sum(r["wide"] for r in own.values()))
        quotas, base = [], opened
        for at in sorted(own):
            quotas.append((at, quota := min(own[at]["n"], n + opened - base), base))
            base += quota
        opened = base
        ranked = swept.where(F.col("kind") == PIECE).join(table(quotas, "of int, quota bigint, base bigint"), F.col("at") == F.col("of"))
        seeds = ranked.where("nth < quota").select("name", "size", (F.col("base") + F.col("nth")).alias("sequence_id"))
        placed.append(seeds.select(F.col("name").alias("tag"), "sequence_id", F.lit(0).cast("long").alias("offset")))
        opens = seeds.select(F.lit(GAP).alias("kind"), F.col("sequence_id").alias("name"), (F.lit(capacity) - F.col("size")).alias("size")).where("size > 0")
        rows = union([ranked.where("nth >= quota").select("kind", "name", "size"), left(swept).where(F.col("kind") == GAP), opens])
    return union(placed)


def pack_documents(
    df: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS,
    least_rows: int = LEAST_RANGE_ROWS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    pieces = stored(tokenise_pieces(df, capacity, tokenizer_path or default_path(), end_id, id_col, text_col))
    places = place(pieces.select("tag", "length"), capacity, range_rows, least_rows)
    return pieces.join(places, "tag").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
