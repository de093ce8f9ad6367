"""Scores from something that answers questions in batches: fit the state, pack the questions, ask, salvage.

The answers are written once they are there, so nothing is asked again because
its rows are read twice.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ready, table
from .fit import batch_calls, fitted_states

#: A request: the session's state (JSON) and questions (call, tool, input, chars, error); the answer has keep_call and keep_result for each call.
Asker = Callable[[str, list[dict]], dict[int, tuple[float, float]]]

_REPLY = "session_id string, batch int, attempts int, error string, answers array<struct<call_seq: int, keep_call: double, keep_result: double>>"


@dataclass(frozen=True)
class AskOptions:
    state_tokens: int = 25_000
    request_tokens: int = 30_000
    retries: int = 1
    concurrency: int = 4
    #: Tasks that ask at the same time, each with concurrency requests in flight.
    tasks: int = 4
    preserve_recent: int = 6


def probability(value) -> float:
    """A number from 0 to 1; anything else is a malformed answer."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"{value!r} is no probability")
    return float(value)


def ask_once(asker: Asker, state: str, questions: list[dict], retries: int) -> tuple[int, str | None, list[dict] | None]:
    """Attempts, the last error, and the answers if an attempt gave all of them."""
    error = None
    for attempt in range(1, retries + 2):
        try:
            given = asker(state, questions)
            return attempt, None, [dict(zip(("call_seq", "keep_call", "keep_result"), (q["call"], *map(probability, given[q["call"]])))) for q in questions]
        except Exception as e:  # noqa: BLE001  whatever an asker raises costs this batch only
            error = f"{type(e).__name__}: {e}"
    return retries + 1, error, None


def requests(states: DataFrame, calls: DataFrame, request_tokens: int) -> DataFrame:
    """A row per request: session_id, batch, state, questions (JSON). Sessions without a state ask nothing."""
    own = calls.join(states.filter("state is not null").select("session_id", F.col("tokens").alias("overhead")), "session_id")
    packed = batch_calls(own, request_tokens, "overhead").select("session_id", "call_seq", "batch")
    question = F.struct(F.col("call_seq").alias("call"), "tool", "input", F.col("result_chars").alias("chars"), F.col("is_error").alias("error"))
    listed = own.join(packed, ["session_id", "call_seq"]).groupBy("session_id", "batch").agg(F.array_sort(F.collect_list(question)).alias("q"))  # of a request's size at most
    return listed.join(states.select("session_id", "state"), "session_id").select("session_id", "batch", "state", F.to_json("q").alias("questions"))


def replies(asked: DataFrame, asker: Asker, options: AskOptions) -> DataFrame:
    """What came of each request: session_id, batch, attempts, error, answers (null if all attempts failed). Written when this is called.

    A run in which every request failed is an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ready(asked.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(_REPLY))

    def run(batches):
        with ThreadPoolExecutor(options.concurrency) as pool:
            for b in batches:
                rows = list(zip(*(c.to_pylist() for c in b.columns)))
                made = pool.map(lambda r: ask_once(asker, r[2], json.loads(r[3]), options.retries), rows)
                yield from pa.Table.from_pylist([{"session_id": r[0], "batch": r[1], "attempts": n, "error": e, "answers": a} for r, (n, e, a) in zip(rows, made)], schema=schema).to_batches()

    made = table(asked.repartition(options.tasks, "session_id", "batch").mapInArrow(run, _REPLY), "replies")
    n, failed, error = made.agg(F.count("*"), F.count_if(F.col("answers").isNull()), F.max("error")).first()
    if n and n == failed:
        raise RuntimeError(f"all {n} requests failed; one said {error}")
    return made


class BatchScorer:
    """A scorer that asks: calls get keep_call and keep_result, and unscored where their request failed or their session fits no state."""

    default_threshold = 0.35

    def __init__(self, messages: DataFrame, asker: Asker, options: AskOptions | None = None):
        self.messages, self.asker, self.options = messages, asker, options or AskOptions()
        self.states: DataFrame | None = None
        self.replies: DataFrame | None = None

    def score(self, calls: DataFrame) -> DataFrame:
        o = self.options
        self.states = table(fitted_states(self.messages, calls, o.state_tokens, o.preserve_recent), "states")
        self.replies = replies(requests(self.states, calls, o.request_tokens), self.asker, o)
        answers = self.replies.select("session_id", F.inline("answers")).withColumn("_answered", F.lit(True))
        return calls.join(answers, ["session_id", "call_seq"], "left").withColumn("unscored", F.col("_answered").isNull()).drop("_answered")

    def stats(self) -> DataFrame:
        """Per session: stage, state_tokens, requests, failed requests."""
        sent = self.replies.groupBy("session_id").agg(F.sum("attempts").alias("requests"), F.count_if(F.col("answers").isNull()).alias("failed"))
        return self.states.join(sent, "session_id", "left").select("session_id", "stage", F.col("tokens").alias("state_tokens"), F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("failed", F.lit(0)).alias("failed"))
