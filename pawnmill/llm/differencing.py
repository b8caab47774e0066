"""Packing into near-equal windows by multiway differencing (Karmarkar and Karp).

A partial partition holds one sum for each window. The two partitions with the largest
imbalances merge with opposing ones: the largest window of one takes the smallest of the
other, so their differences cancel. One partition is left, of near-equal windows. Their
number is the least that the tokens need, and rises while a window exceeds the capacity.

Where pieces may be cut, the last differences are levelled by cutting: what a window holds
beyond the capacity moves into windows with room, so it rises only if no cut could help.

Each task packs its own rows as they come, in groups of GROUP windows' tokens (a piece at a
group's end is cut there), and keeps at most one group in memory. Full-length parts of long
documents are windows of their own. What a task has left at its end, less than one window, is
stored with its ids; the tasks of the next round take the rests of many tasks, until one task
holds less than ROUND tokens of rests, whatever the corpus. The last rest is cut into windows
whose lengths are powers of two. So nothing is shuffled but rests, no window has padding, and
a lost task is done again by itself.

Defined results: null text is empty, one end token; an empty table gives no rows; repeated
rows are packed once each; a null id is packed like any other; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .byte_tokens import default_path, worker_byte_tokenizer
from .common import col, parts, stored

CAPACITY, END_ID = 1024, 0
#: Windows packed together, and tokens of rests that a task of a later round takes, about.
GROUP, ROUND = 256, 1 << 20
_SUM = itemgetter(0)


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Members (places in ``lengths``) of k windows with near-equal sums."""
    # a partition: (sum, members as nested pairs) of its windows that hold something, descending
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over > 0:  # a's least windows meet b's, the lesser of one with the greater of the other
            met = [(x + y, (m, n)) for (x, m), (y, n) in zip(a[len(a) - over :], reversed(b[len(b) - over :]))]
            a, b = a[: len(a) - over] + met, b[: len(b) - over]
        merged = sorted(a + b, key=_SUM, reverse=True)
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == k else 0) - merged[0][0], tie, merged))
        tie += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        members, todo = [], [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node)
            else:
                members.append(node)
        out.append(members)
    return out + [[] for _ in range(k - len(out))]


def level(windows: list[list[int]], lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (member, from, to) within the capacity: surplus is cut off the longest members and fills the room of others."""
    out, moved, room = [], [], []
    for members in windows:
        cut = [(i, 0, lengths[i]) for i in sorted(members, key=lengths.__getitem__, reverse=True)]
        extra = sum(lengths[i] for i in members) - capacity
        while extra > 0:
            i, start, end = cut.pop(0)
            take = min(extra, end - start)
            moved.append((i, end - take, end))
            if take < end - start:
                cut.insert(0, (i, start, end - take))
            extra -= take
        if extra < 0:
            room.append((extra, len(out)))
        out.append(cut)
    room.sort()
    moved.sort(key=lambda m: m[1] - m[2])
    free, to = 0, -1
    at = 0
    while at < len(moved):
        if not free:
            if not room:
                raise ValueError("the members exceed the windows")
            less, to = room.pop(0)
            free = -less
        i, start, end = moved[at]
        take = min(free, end - start)
        out[to].append((i, start, start + take))
        free -= take
        if take == end - start:
            at += 1
        else:
            moved[at] = (i, start + take, end)
    return out


def fill(lengths: list[int], capacity: int, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Windows of (member, from, to), none over the capacity: as few as hold them all, more while one is too full."""
    k = -(-sum(lengths) // capacity)
    while True:
        windows = difference(lengths, k)
        if cut:
            return level(windows, lengths, capacity)
        if all(sum(lengths[i] for i in members) <= capacity for members in windows):
            return [[(i, 0, lengths[i]) for i in members] for members in windows]
        k += 1


class Packer:
    """Packs pieces (id, tokens of the document, start, raw ids) as they come; windows leave as lists of pieces."""

    def __init__(self, capacity: int, group: int, cut: bool):
        self.capacity, self.most, self.cut = capacity, group * capacity, cut
        self.held: list[tuple] = []
        self.tokens = 0

    def _windows(self, pieces: list[tuple]) -> Iterator[list[tuple]]:
        for window in fill([len(p[3]) // 4 for p in pieces], self.capacity, self.cut):
            if window:
                yield [(pieces[i][0], pieces[i][1], pieces[i][2] + a, pieces[i][3][4 * a : 4 * b]) for i, a, b in window]

    def add(self, owner: object, total: int, start: int, raw: bytes) -> Iterator[list[tuple]]:
        n, whole = len(raw) // 4, len(raw) // 4 // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            yield [(owner, total, start + a, raw[4 * a : 4 * (a + self.capacity)])]
        if n > whole:
            self.held.append((owner, total, start + whole, raw[4 * whole :]))
            self.tokens += n - whole
        if self.tokens >= self.most:
            pieces, self.held = self._cut(self.most) if self.cut else (self.held, [])
            self.tokens = sum(len(p[3]) // 4 for p in self.held)
            yield from self._windows(pieces)

    def _cut(self, tokens: int) -> tuple[list[tuple], list[tuple]]:
        """The first ``tokens`` of what is held, and the rest; one piece at most is cut."""
        at = 0
        for i, (owner, total, start, raw) in enumerate(self.held):
            n = len(raw) // 4
            if at + n >= tokens:
                own = 4 * (tokens - at)
                tail = [(owner, total, start + tokens - at, raw[own:])] if at + n > tokens else []
                head = [(owner, total, start, raw[:own])] if own else []
                return self.held[:i] + head, tail + self.held[i + 1 :]
            at += n
        return self.held, []

    def close(self, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
        """The windows of what is held; with cuts, full ones only, and the rest of less than a window (if ``last``: as windows, of powers of two)."""
        if not self.cut:
            return list(self._windows(self.held)), []
        full, self.held = self._cut(self.tokens // self.capacity * self.capacity)
        windows = list(self._windows(full))
        left = self.tokens % self.capacity
        if not last:
            return windows, self.held
        while left:
            power = 1 << left.bit_length() - 1
            head, self.held = self._cut(power)
            windows.append(head)
            left -= power
        return windows, []


def _pack(batches: Iterable[Iterable[tuple]], at: int, id_type: pa.DataType, capacity: int, group: int, cut: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of all windows of one task; the rest has no window, but its ids."""
    packer, n = Packer(capacity, group, cut), 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [id_type, *[pa.int64()] * 6, pa.binary()]
    rows: list[tuple] = []

    def give(windows: Iterable[list[tuple]]) -> None:
        nonlocal n
        for window in windows:
            offset = 0
            for owner, total, start, raw in window:
                rows.append((owner, start, len(raw) // 4, zlib.crc32(raw), total, at | n, offset, None))
                offset += len(raw) // 4
            n += 1

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        rows.clear()
        return out

    for pieces in batches:
        for piece in pieces:
            give(packer.add(*piece))
        if rows:
            yield batch()
    windows, rest = packer.close(last)
    give(windows)
    rows += [(owner, start, len(raw) // 4, zlib.crc32(raw), total, None, None, raw) for owner, total, start, raw in rest]
    if rows:
        yield batch()


def pack_windows(
    df: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cut: bool = True, group: int = GROUP
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Without ``cut``, documents are cut only where longer than the capacity, and windows of each
    group of a task rise in number until they hold its pieces.
    """
    path, end = tokenizer_path or default_path(), int(end_id).to_bytes(4, "little")
    id_type = df.schema[id_col].dataType
    arrow = to_arrow_type(id_type)
    schema = f"doc_id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_byte_tokenizer(path)

        def documents(part: pa.RecordBatch) -> Iterator[tuple]:
            for owner, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = tokenizer.encode(text or "") + end
                yield owner, len(raw) // 4, 0, raw

        each = (documents(part) for batch in batches for part in parts(batch))
        yield from _pack(each, TaskContext.get().partitionId() << 36, arrow, capacity, group, cut, last=False)

    def again(turn: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = (zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids"))) for batch in batches)
            yield from _pack(each, turn << 58 | TaskContext.get().partitionId() << 36, arrow, capacity, group, cut, last)

        return run

    out, turn, last = [stored(df.select(col(id_col), col(text_col)).mapInArrow(first, schema))], 0, not cut
    while not last:
        turn += 1
        rests = out[-1].where("ids IS NOT NULL").select("doc_id", "doc_tokens", "start", "ids")
        tokens = out[-1].where("ids IS NOT NULL").agg(F.sum("length")).first()[0] or 0
        last = tokens <= ROUND
        out.append(stored(rests.coalesce(-(-tokens // ROUND) or 1).mapInArrow(again(turn, last), schema)))
    return reduce(DataFrame.unionByName, [o.where("ids IS NULL").drop("ids") for o in out])
