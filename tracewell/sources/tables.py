"""Transcripts from plain tables: turns of conversations, and tool calls from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TOOL_RESULT, TOOL_USE


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages_from_conversations(conversations: DataFrame) -> DataFrame:
    """A message per turn."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("int").alias("message_index"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        F.array().cast(f"array<{TOOL_USE}>").alias("tool_uses"),
        F.array().cast(f"array<{TOOL_RESULT}>").alias("tool_results"),
    )


def messages_from_events(events: DataFrame) -> DataFrame:
    """Two messages per event of a user: an assistant's tool call, and its result.

    The kind of event gives the tool, the number k in props its target and the
    length of the result.  Some calls come with a sentence that names the
    target, some results with a user's quote of their first line.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("user_id", "event_id", "event_type", k.alias("k"), (F.row_number().over(order) - 1).alias("n"))
    kind, k = F.col("event_type"), F.col("k").cast("string")
    tool = F.when(kind == "view", "Read").when(kind == "click", "Grep").when(kind == "purchase", "Edit").when((kind == "signup") & (F.col("k") >= 90), "WebFetch").otherwise("Bash")
    path = F.concat(F.lit("src/f"), k, F.lit(".ts"))
    given = F.when(tool == "Bash", F.concat(F.lit('{"command":"run '), k, F.lit('"}'))).when(tool == "WebFetch", F.concat(F.lit('{"url":"https://example.org/'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"file_path":"'), path, F.lit('"}')))
    line = F.concat(kind, F.lit(" printed this line, of forty characters or more, about "), path)
    result = F.repeat(F.concat(line, F.lit("\n")), F.col("k") % 5 + 1)
    rows = rows.select(
        F.col("user_id").cast("string").alias("session_id"),
        "n",
        tool.alias("tool"),
        given.alias("input"),
        result.alias("result"),
        (kind == "error").alias("is_error"),
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("Looking at "), path, F.lit(" again."))).otherwise(F.lit("")).alias("said"),
        F.when(F.col("k") % 25 == 0, F.concat(F.lit("You saw this:\n"), line)).otherwise(F.lit("")).alias("quoted"),
    )
    use = F.array(F.struct(F.col("id").alias("tool_use_id"), "tool", "input", F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("is_error"))).cast(f"array<{TOOL_USE}>")
    answer = F.array(F.struct(F.col("id").alias("tool_use_id"), F.col("result").alias("text"), "is_error")).cast(f"array<{TOOL_RESULT}>")
    asked = F.struct((F.col("n") * 2).cast("int").alias("message_index"), F.lit("assistant").alias("role"), F.col("said").alias("text"), use.alias("tool_uses"), F.array().cast(f"array<{TOOL_RESULT}>").alias("tool_results"))
    told = F.struct((F.col("n") * 2 + 1).cast("int").alias("message_index"), F.lit("user").alias("role"), F.col("quoted").alias("text"), F.array().cast(f"array<{TOOL_USE}>").alias("tool_uses"), answer.alias("tool_results"))
    return rows.select("session_id", F.inline(F.array(asked, told)))


def archive_from_documents(documents: DataFrame) -> DataFrame:
    """Archive records: a document each, its source the session, its language the tool."""
    from ..functions.text import content_hash, estimate_tokens

    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("session_id"),
        F.col("doc_id").cast("long").alias("seq"),
        F.lit("tool_result").alias("kind"),
        F.coalesce("text", F.lit("")).alias("content"),
        content_hash(F.col("text")).alias("content_hash"),
        estimate_tokens(F.col("text")).alias("token_estimate"),
        F.col("lang").alias("tool_name"),
        F.to_json(F.struct(F.col("lang").alias("tool"))).alias("metadata"),
    )
