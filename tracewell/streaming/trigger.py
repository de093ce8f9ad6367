"""When a session is large enough to compact: as a batch fold, and as a stream with state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import ready

GROWTH = 1.25


def fires(total: float, attempted: float, threshold: float) -> tuple[bool, float]:
    """Whether a total fires, and what the last attempt is then: once per crossing, and again after growing by a quarter."""
    if total < threshold:
        return False, 0.0
    if attempted and total < attempted * GROWTH:
        return False, attempted
    return True, float(total)


def threshold_of(at_tokens: int, context_window: int | None = None, percent: float | None = None) -> int:
    """Tokens at which a session is large: a number, or a share of the context window if that is less."""
    if percent is None or not context_window:
        return at_tokens
    return min(at_tokens, int(context_window * min(max(percent, 0.0), 100.0) / 100))


def auto_trigger(turns: DataFrame, threshold: int) -> DataFrame:
    """The turns (session_id, turn, tokens) at which a session fires: session_id, turn, total. A fold over each session's running total."""
    listed = F.array_sort(F.collect_list(F.struct("turn", F.col("tokens").cast("double").alias("tokens"))))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("attempted"), F.array().cast("array<struct<turn: bigint, total: bigint>>").alias("out"))

    def add(a, t):
        total = a["total"] + t["tokens"]
        fire = (total >= threshold) & ((a["attempted"] == 0) | (total >= a["attempted"] * GROWTH))
        attempted = F.when(total < threshold, 0.0).when(fire, total).otherwise(a["attempted"])
        row = F.array(F.struct(t["turn"].cast("long").alias("turn"), total.cast("long").alias("total")))
        return F.struct(total.alias("total"), attempted.alias("attempted"), F.when(fire, F.concat(a["out"], row)).otherwise(a["out"]).alias("out"))

    return turns.groupBy("session_id").agg(F.aggregate(listed, zero, add, lambda a: a["out"]).alias("o")).select("session_id", F.inline("o"))


def trigger_stream(turns: DataFrame, threshold: int) -> DataFrame:
    """auto_trigger() over a stream of turns; within a micro-batch a session's turns go in order."""
    ready(turns.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, attempted = state.get if state.exists else (0.0, 0.0)
        out = []
        for row in pd.concat(list(frames)).sort_values("turn").itertuples():
            total += row.tokens
            fire, attempted = fires(total, attempted, threshold)
            if fire:
                out.append((key[0], int(row.turn), int(total)))
        state.update((float(total), float(attempted)))
        yield pd.DataFrame(out, columns=["session_id", "turn", "total"])

    return turns.groupBy("session_id").applyInPandasWithState(step, "session_id string, turn long, total long", "total double, attempted double", "append", GroupStateTimeout.NoTimeout)


class _Trigger(StatefulProcessor):
    """A session's running total and last attempt, as values that end by themselves when a session is idle."""

    def __init__(self, threshold: int, idle_ms: int):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trigger", "total double, attempted double", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, attempted = self.state.get() if self.state.exists() else (0.0, 0.0)
        out = []
        for row in pd.concat(list(rows)).sort_values("turn").itertuples():
            total += row.tokens
            fire, attempted = fires(total, attempted, self.threshold)
            if fire:
                out.append((key[0], int(row.turn), int(total)))
        self.state.update((float(total), float(attempted)))
        yield pd.DataFrame(out, columns=["session_id", "turn", "total"])

    def close(self) -> None:
        pass


def ending_trigger_stream(turns: DataFrame, threshold: int, idle_ms: int) -> DataFrame:
    """trigger_stream() whose state for a session ends when no turn has come for idle_ms: it begins at nothing again, and is armed.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    ready(turns.sparkSession)
    return turns.groupBy("session_id").transformWithStateInPandas(_Trigger(threshold, idle_ms), "session_id string, turn long, total long", "Append", "ProcessingTime")
