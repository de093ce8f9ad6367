"""Tokens over time, of tables and of streams: windows of event time, and sessions of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(turns: DataFrame, late: str | None) -> DataFrame:
    """turns with ts as a timestamp; of a stream, rows that come more than late after newer ones are too late."""
    rows = turns.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late and turns.isStreaming else rows


def tokens_by_window(turns: DataFrame, width: str, slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Per session and window of ts: session_id, begins, ends, turns, tokens of turns (session_id, ts, tokens)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = _timed(turns, late).groupBy("session_id", window.alias("w")).agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))
    return sums.select("session_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "turns", "tokens")


def tokens_by_activity(turns: DataFrame, gap: str, late: str | None = "10 minutes") -> DataFrame:
    """Per session and stretch of turns of which none is a gap or more after the one before: session_id, begins, ends (a gap after the last), turns, tokens."""
    sums = _timed(turns, late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))
    return sums.select("session_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "turns", "tokens")


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query has left out as too late, as far as its recent progress tells."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
