"""Messages to flat events and paired tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json, content_hash, estimate_tokens, input_path, json_string, normal_path


def with_pins(messages: DataFrame, preserve_recent: int) -> DataFrame:
    """messages with total (of the session) and pinned: the first and the newest."""
    total = F.count("*").over(Window.partitionBy("session_id"))
    return messages.withColumn("total", total.cast("int")).withColumn("pinned", (F.col("message_index") == 0) | (F.col("message_index") >= F.col("total") - preserve_recent))


def _event_base(kind: Column, tool_use_id: Column, content: Column) -> Column:
    return F.concat(F.lit("e_"), content_hash(kind, tool_use_id, content))


def _event_id(base: Column, nth: Column) -> Column:
    return F.when(nth > 1, F.concat(base, F.lit("~"), nth.cast("string"))).otherwise(base)


def ledger(messages: DataFrame) -> DataFrame:
    """One row per event: a message's text if it isn't blank, then its tool uses, then its tool results.

    seq counts a session's events; event_id is made of kind, tool_use_id and
    content, and the n-th of identical events ends in ~n.
    """
    none = F.lit(None).cast("string")

    def event(kind, content, tool=none, use=none, given=none, is_error=None):
        is_error = F.lit(None).cast("boolean") if is_error is None else is_error
        return F.struct(kind.alias("kind"), content.alias("content"), tool.alias("tool_name"), use.alias("tool_use_id"), given.alias("tool_input"), is_error.alias("is_error"))

    text = F.when(F.trim(F.regexp_replace("text", r"[\t-\r ]", "")) != "", F.array(event(F.concat(F.when(F.col("role") == "assistant", "assistant").otherwise("user"), F.lit("_text")), F.col("text")))).otherwise(F.array())
    uses = F.transform("tool_uses", lambda u: event(F.lit("tool_use"), u["input"], u["tool"], u["tool_use_id"], u["input"], u["is_error"]))
    results = F.transform("tool_results", lambda r: event(F.lit("tool_result"), F.coalesce(r["text"], F.lit("")), none, r["tool_use_id"], none, r["is_error"]))
    rows = messages.select("session_id", "message_index", "role", F.posexplode(F.concat(text, uses, results)).alias("pos", "e")).select("session_id", "message_index", "role", "pos", "e.*")
    rows = rows.withColumn("seq", (F.row_number().over(Window.partitionBy("session_id").orderBy("message_index", "pos")) - 1).cast("long"))
    base = _event_base(F.col("kind"), F.col("tool_use_id"), F.col("content"))
    rows = rows.withColumn("base", base).withColumn("nth", F.row_number().over(Window.partitionBy("session_id", "base").orderBy("seq")))
    hashed = F.when(F.col("kind") == "tool_use", content_hash(F.col("tool_name"), F.col("content"))).otherwise(content_hash(F.col("content")))
    return rows.select(
        "session_id",
        "seq",
        _event_id(F.col("base"), F.col("nth")).alias("event_id"),
        F.when(F.col("kind") == "tool_result", "tool").otherwise(F.col("role")).alias("role"),
        "kind",
        "content",
        "tool_name",
        "tool_use_id",
        "tool_input",
        "is_error",
        "message_index",
        hashed.alias("content_hash"),
        estimate_tokens(F.col("content")).alias("token_estimate"),
    )


def interactions(events: DataFrame) -> DataFrame:
    """Per tool_use_id the last use and, if there is one, the last result."""
    of = events.filter("kind in ('tool_use', 'tool_result')").groupBy("session_id", "tool_use_id")
    last = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.col("seq")))
    return of.agg(
        last("tool_use", "event_id").alias("use_id"),
        last("tool_result", "event_id").alias("result_id"),
        last("tool_use", "tool_name").alias("tool_name"),
    ).filter("use_id is not null")


def transcript_hash(messages: DataFrame) -> DataFrame:
    """One hash per session over its messages in order."""
    row = F.to_json(F.struct("role", "text", "tool_uses", "tool_results"))
    return messages.groupBy("session_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", row.alias("j")))), lambda x: x["j"]), "\n"), 256).alias("transcript_hash"))


def tool_calls(messages: DataFrame, preserve_recent: int = 6, archive_ids: bool = False) -> DataFrame:
    """Uses joined with the last result of their id; uses without a result have no row.

    call_seq numbers a session's pairs from 1 in order of use; ambiguous marks
    ids that are used more than once; path is normalised, raw_path isn't.  With
    archive_ids, archive_id is the event_id that ledger() gives that result.
    """
    totals = with_pins(messages, preserve_recent).select("session_id", "message_index", "total", "pinned", "tool_uses", "tool_results")
    no = lambda kind: F.lit(None).cast(kind)
    part = lambda use, pos, x, tool, given, told, failed: F.struct(F.lit(use).alias("use"), pos.alias("pos"), x["tool_use_id"].alias("tool_use_id"), tool.alias("tool"), given.alias("input"), told.alias("result"), failed.alias("is_error"))
    uses = F.transform("tool_uses", lambda u, i: part(True, i, u, u["tool"], u["input"], no("string"), no("boolean")))
    results = F.transform("tool_results", lambda r, i: part(False, i, r, no("string"), no("string"), r["text"], F.coalesce(r["is_error"], F.lit(False))))
    rows = totals.select("session_id", F.col("message_index").alias("call_index"), "total", "pinned", F.inline_outer(F.concat(uses, results))).filter("tool_use_id is not null")
    # Uses meet their result in a window, not in a join: the session's partitioning stays.
    own = Window.partitionBy("session_id", "tool_use_id")
    rows = rows.withColumn("base", _event_base(F.lit("tool_result"), F.col("tool_use_id"), F.col("result"))) if archive_ids else rows
    last = F.max(F.when(~F.col("use"), F.struct(F.col("call_index").alias("result_index"), "pos", F.col("pinned").alias("result_pinned"), "result", "is_error", *["base"] * archive_ids))).over(own)
    # Of an id's results those that say the same as the last are counted: it is the n-th of them.
    same = {"same": F.collect_list(F.when(~F.col("use"), F.col("base"))).over(own)} if archive_ids else {}
    rows = rows.withColumns({"last": last, "ambiguous": F.count_if("use").over(own) > 1} | same).filter("use and last is not null")
    ids = [_event_id(F.col("last.base"), F.size(F.filter("same", lambda x: x == F.col("last.base")))).alias("archive_id")] if archive_ids else []
    # Fields of the input are read once each, before what is made of them.
    rows = rows.select(
        "session_id",
        F.row_number().over(Window.partitionBy("session_id").orderBy("call_index", "pos")).alias("call_seq"),
        "tool_use_id",
        "tool",
        "input",
        canonical_json(F.col("input")).alias("canonical_input"),
        input_path(F.col("input")).alias("raw_path"),
        json_string(F.col("input"), "command").alias("command"),
        F.coalesce("last.result", F.lit("")).alias("result"),
        "last.is_error",
        "call_index",
        "last.result_index",
        "total",
        (F.col("pinned") | F.col("last.result_pinned")).alias("pinned"),
        "ambiguous",
        *ids,
    )
    return rows.select("session_id", "call_seq", "tool_use_id", "tool", "input", "canonical_input", normal_path(F.col("raw_path")).alias("path"), "raw_path", "command", "result", F.length("result").alias("result_chars"), "is_error", "call_index", "result_index", "total", "pinned", "ambiguous", *["archive_id"] * archive_ids)


def session_totals(messages: DataFrame, preserve_recent: int = 6) -> DataFrame:
    """Per session: messages, tokens and characters of their texts, and pinned messages."""
    return with_pins(messages, preserve_recent).groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.sum(estimate_tokens(F.col("text"))).alias("tokens"),
        F.sum(F.length("text")).cast("long").alias("chars"),
        F.count_if("pinned").alias("pinned_messages"),
    )


def message_chars(messages: DataFrame) -> DataFrame:
    """Characters of each message: its text, the inputs of its uses, its results."""
    inputs = F.aggregate("tool_uses", F.lit(0), lambda n, u: n + F.length(u["input"]))
    results = F.aggregate("tool_results", F.lit(0), lambda n, r: n + F.length(F.coalesce(r["text"], F.lit(""))))
    return messages.select("session_id", "message_index", (F.length("text") + inputs + results).cast("long").alias("chars"))
