"""Structured Streaming: games to examples, a growing record log, running metrics, live games."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import games as G
from ..operators.records import decode_records, with_event_ids
from ..operators.vocabulary import token_list
from ..schemas import superset
from ..session import checkpointed


def stream_examples(spark: SparkSession, source: str, out: str, checkpoint: str, high_elo: bool = False) -> StreamingQuery:
    """New game files become example files, each micro-batch exactly once; ends when all are read.

    A stream's limit keeps whatever comes first, so limits on games belong to the batch plan.
    """
    from ..sources.scans import read_games

    raw = read_games(spark, source, stream=True).where(G.base_filter())
    if high_elo:
        raw = raw.where(G.high_elo_filter())
    examples = G.tokenized_examples(G.classify_games(G.parse_movetext(raw)), token_list())
    return examples.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_records(spark: SparkSession, source: str) -> DataFrame:
    """Records of JSON-lines files as they appear."""
    return decode_records(spark.readStream.text(source), "value", strict=False)


def append_stream(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A crash-safe record log: files of a micro-batch appear whole or not at all."""
    present = [f.name for f in superset().fields if f.name in records.columns]
    return records.select(*present).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false").trigger(availableNow=True).start()


def running_win_counts(records: DataFrame) -> DataFrame:
    """Game counts by side and result over all files so far (output mode complete)."""
    return records.where("record_type = 'per_game'").groupBy("model_side", "result").agg(F.count(F.lit(1)).alias("games"))


#: Odd multipliers of a 64-bit mixing step, fixed.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def rolling_prefix(tokens: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of every prefix of tokens, the empty one first: exclusive-ors of mixed (place, token) pairs."""
    out = np.zeros((len(tokens) + 1, 2), dtype=np.uint64)
    place = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    for k, seed in enumerate((0, 1)):
        x = tokens.astype(np.int64).view(np.uint64) * np.uint64(MIX[0]) + place * np.uint64(MIX[1]) + np.uint64(seed)
        for shift, by in ((30, MIX[1]), (27, MIX[2])):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        out[1:, k] = np.bitwise_xor.accumulate(x ^ (x >> np.uint64(31)))
    return out


class PrefixProcessor(StatefulProcessor):
    """Says whether a game's next tokens extend the last ones, from the last ones' length and digest alone.

    State is only a short cut: a line that does not strictly extend the stored prefix is
    scored from scratch, with the same result.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n int, d1 long, d2 long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = tuple(self.last.get()) if self.last.exists() else (0, 0, 0)
        out = []
        frames = [f for f in rows if len(f)]
        if frames:
            for row in pd.concat(frames).sort_values("ply").itertuples():
                tokens = np.asarray(row.input_ids if row.input_ids is not None else [], dtype=np.int64)
                digests = rolling_prefix(tokens).view(np.int64)
                n = known[0]
                extends = n < len(tokens) and tuple(digests[n].tolist()) == known[1:]
                out.append((key[0], int(row.ply), len(tokens), n if extends else 0))
                known = (0, 0, 0) if row.ended else (len(tokens), *digests[-1].tolist())
        if known[0]:
            self.last.update(known)
        else:
            self.last.clear()
        yield pd.DataFrame(out, columns=["game_id", "ply", "n_tokens", "n_reused"]).astype({"ply": "int32", "n_tokens": "int32", "n_reused": "int32"})

    def close(self) -> None:
        pass


PREFIX_OUT = "game_id string, ply int, n_tokens int, n_reused int"


def prefix_reuse(turns: DataFrame) -> DataFrame:
    """game_id, ply, n_tokens, n_reused of a stream (game_id, ply, input_ids, ended); needs the RocksDB state store."""
    return turns.groupBy("game_id").transformWithStateInPandas(PrefixProcessor(), PREFIX_OUT, "Append", "None")


def prefix_reuse_batch(turns: DataFrame) -> DataFrame:
    """The same over a bounded table, by built-in functions: a line's own prefix, as long as the line before it, has that line's digests.

    Lines are numbered in their games by ranges and meet the next line by its number, so a
    game that holds most lines is split like any other.
    """
    digests = lambda ids: (F.xxhash64(ids), F.xxhash64(F.lit("second"), ids))
    ids = F.coalesce("input_ids", F.array().cast("array<int>"))
    lines = with_event_ids(turns.select("game_id", "ply", ids.alias("ids"), F.coalesce("ended", F.lit(False)).alias("ended")), "game_id", "ply", out="nth")
    lines = checkpointed(lines)
    d1, d2 = digests(F.col("ids"))
    ahead = lines.where(~F.col("ended") & (F.size("ids") > 0)).select(F.col("game_id").alias("__game"), (F.col("nth") + 1).alias("__nth"), F.size("ids").alias("__n"), d1.alias("__d1"), d2.alias("__d2"))
    met = lines.join(ahead, F.col("game_id").eqNullSafe(F.col("__game")) & (F.col("nth") == F.col("__nth")), "left")
    own1, own2 = digests(F.slice("ids", F.lit(1), F.coalesce("__n", F.lit(0))))
    extends = (F.col("__n") < F.size("ids")) & (own1 == F.col("__d1")) & (own2 == F.col("__d2"))
    return met.select("game_id", "ply", F.size("ids").alias("n_tokens"), F.when(extends, F.col("__n")).otherwise(0).alias("n_reused"))


class CounterProcessor(StatefulProcessor):
    """Numbers a run's rows without gaps, in the order of ``nth`` within a micro-batch; state is the next number."""

    def __init__(self, limit: int | None = None):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = int(self.next.get()[0]) if self.next.exists() else 0
        frames = [f for f in rows if len(f)]
        if frames:
            frame = pd.concat(frames).sort_values(["nth", "value"], kind="stable")
            if self.limit is not None:
                frame = frame.head(max(0, self.limit - n))
            ids = np.arange(n, n + len(frame), dtype=np.int64)
            self.next.update((n + len(frame),))
            yield pd.DataFrame({"run_id": frame["run_id"], "event_id": ids, "value": frame["value"]})

    def close(self) -> None:
        pass


def numbered_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    """run_id, event_id, value of a stream (run_id, nth, value): event_id is gap-free from 0 in each run, over all micro-batches and restarts.

    With ``limit``, a run's first rows only, as they come: the state says how many there were.
    Needs the RocksDB state store. A run's rows of one micro-batch are numbered in one task, so
    the trigger bounds what it holds.
    """
    return events.select("run_id", "nth", "value").groupBy("run_id").transformWithStateInPandas(CounterProcessor(limit), "run_id string, event_id long, value string", "Append", "None")
