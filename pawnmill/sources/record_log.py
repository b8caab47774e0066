"""A record log: one JSON-lines file that only grows, written by many tasks.

Each task writes its lines to a file of its own in the log's staging folder. One commit then
appends those files, in the order of partitions, to the log, and notes in the commit file
which batch it was and how long the log is since. Whatever is killed:

- before the commit, the log is as it was, and the staged files are overwritten or swept away;
- within it, the log has a tail that no commit names: readers stop before it, and the next
  commit cuts it off;
- after it, a commit of the same batch adds nothing.

So the log's committed prefix always consists of whole lines of whole batches. Batches of a
stream are named by their number, so a restarted stream appends each one once.

Paths are those of a file system that all executors mount (``file:`` or none). The commit
copies staged files in pieces of PIECE bytes; it holds no batch.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.records import decode_records, encode_records

PIECE = 1 << 20
NAME = "record_log"


def _local(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"a record log lies on a mounted file system, not in {url.scheme}:")
    return unquote(url.path) if url.scheme else path


def _commits(path: str) -> list[dict]:
    """What the commit file names; a torn last line is none."""
    out = []
    if os.path.exists(path + ".commits"):
        with open(path + ".commits", encoding="utf-8") as f:
            for line in f:
                if line.endswith("\n"):
                    out.append(json.loads(line))
    return out


def committed_length(path: str) -> int:
    """Bytes of the log that commits name."""
    done = _commits(_local(path))
    return done[-1]["length"] if done else 0


@dataclass
class Staged(WriterCommitMessage):
    partition: int
    file: str


class _LogWriter:
    """The parts that batch and stream writers share."""

    def __init__(self, path: str, batch: str):
        self.path, self.batch = _local(path), batch
        self.stage = f"{self.path}.staging"

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.stage, exist_ok=True)
        file = f"{self.stage}/{task.partitionId():07d}-{uuid.uuid4().hex}"
        with open(file, "wb") as f:
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    if line is not None:
                        f.write(line.encode() + b"\n")
            f.flush()
            os.fsync(f.fileno())
        return Staged(task.partitionId(), file)

    def append(self, messages: list[Staged | None], batch: str) -> bool:
        """Append the staged files, unless the batch is in the log; False if it is."""
        staged = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        done = _commits(self.path)
        new = all(c["batch"] != batch for c in done)
        if new:
            length = done[-1]["length"] if done else 0
            os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
            with open(self.path, "ab") as log:
                log.truncate(length)
                log.seek(length)
                for m in staged:
                    with open(m.file, "rb") as f:
                        shutil.copyfileobj(f, log, PIECE)
                log.flush()
                os.fsync(log.fileno())
                length = log.tell()
            with open(self.path + ".commits", "ab") as f:
                whole = "".join(json.dumps(c) + "\n" for c in done).encode()
                f.truncate(len(whole))  # a torn line of a commit that never was
                f.seek(len(whole))
                f.write(json.dumps({"batch": batch, "length": length, "files": len(staged)}).encode() + b"\n")
                f.flush()
                os.fsync(f.fileno())
        self.sweep(staged)
        return new

    def sweep(self, staged: list[Staged | None]) -> None:
        for m in staged:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


class LogWriter(_LogWriter, DataSourceArrowWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        self.append(messages, self.batch)

    def abort(self, messages: list[Staged | None]) -> None:
        self.sweep(messages)


class LogStreamWriter(_LogWriter, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.append(messages, f"{self.batch}/{batchId}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.sweep(messages)


class RecordLog(DataSource):
    """Sink of one text column; options path and batch (its name, for a stream its run's)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _options(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("batch") or uuid.uuid4().hex

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a record log only grows")
        return LogWriter(*self._options())

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(*self._options())


def append_records(records: DataFrame, path: str, batch: str, *order: str) -> None:
    """Append records to the log as one batch; a batch that is in it already adds nothing.

    With ``order``, lines follow it: rows are range-sorted, and files appended in that order.
    """
    records.sparkSession.dataSource.register(RecordLog)
    lines = encode_records(records)
    if order:
        parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lines = encode_records(records.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    lines.select("value").write.format(NAME).mode("append").option("path", path).option("batch", batch).save()


def append_stream(records: DataFrame, path: str, checkpoint: str, run: str) -> StreamingQuery:
    """Append a stream's records; each micro-batch is in the log once, also after restarts with the same checkpoint."""
    records.sparkSession.dataSource.register(RecordLog)
    lines = encode_records(records).select("value")
    return lines.writeStream.format(NAME).option("path", path).option("batch", run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Typed records of the committed prefix; lines are read in splits, and what no commit names is not seen."""
    end = committed_length(path)
    torn = os.path.exists(_local(path)) and os.path.getsize(_local(path)) > end
    return decode_records(_prefix_lines(spark, path, end) if torn or not end else spark.read.text(path), "value", strict)


def _prefix_lines(spark: SparkSession, path: str, end: int, piece: int = 64 * PIECE) -> DataFrame:
    """Lines of the first ``end`` bytes, by byte ranges; a line belongs to the range it begins in."""
    starts = spark.range(0, max(end, 1), piece, max(1, -(-end // piece)))
    local = _local(path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in batch.column(0).to_pylist():
                lines, stop = [], min(start + piece, end)
                with open(local, "rb") as f:
                    f.seek(max(0, start - 1))
                    if start:
                        f.readline()  # ends in this range or is the one before's
                    while f.tell() < stop and len(line := f.readline()):
                        lines.append(line.rstrip(b"\r\n").decode())
                        if len(lines) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                            lines = []
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return starts.mapInArrow(run, "value string")


def sweep_staging(path: str) -> int:
    """Remove staged files that lost tasks have left; only while nothing is being written."""
    files = glob.glob(f"{_local(path)}.staging/*")
    for f in files:
        os.remove(f)
    return len(files)
