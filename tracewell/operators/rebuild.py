"""Decisions applied: archive rows, and a transcript with stubs and markers in place of what left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import input_summary
from ..schema import TOOL_RESULT, TOOL_USE
from .ledger import interactions, ledger
from .scoring import DROPS_CALL

KEEPS = ("PIN_VERBATIM", "KEEP_VERBATIM")


def stub(text: Column, d: Column, head: int) -> Column:
    """What stays of an evicted result: its head and a note of where the rest is; short ones stay whole."""
    text = F.coalesce(text, F.lit(""))
    top = F.concat(F.substring(text, 1, head), F.lit("\n")) if head > 0 else F.lit("")
    what = F.concat((F.length(text) - head).cast("string"), F.lit(" more chars of this "), d["tool"], F.lit(" result"), F.when(d["is_error"], F.lit(" (error)")).otherwise(F.lit("")))
    about = F.when(d["about"] != "", F.concat(F.lit(" ("), d["about"], F.lit(")"))).otherwise(F.lit(""))
    again = F.concat(F.lit("re-run "), d["tool"], F.lit(" with the same input, or restore "), d["archive_id"])
    how = F.when(d["action"] == "RERUN_ON_DEMAND", again).otherwise(F.concat(F.lit("restore "), d["archive_id"], F.lit(" brings it back, or re-run the tool")))
    return F.when(F.length(text) <= head + 120, text).otherwise(F.concat(top, F.lit("[archived "), d["archive_id"], F.lit(": "), what, about, F.lit("; "), how, F.lit("]")))


def marker(items: Column) -> Column:
    """The note for calls that were removed, one item each."""
    n = F.size(items)
    return F.concat(F.lit("[archived "), n.cast("string"), F.when(n == 1, F.lit(" tool call")).otherwise(F.lit(" tool calls")), F.lit(" made here: "), F.array_join(items, "; "), F.lit(" - out of context]"))


def evictions(messages: DataFrame, decisions: DataFrame) -> DataFrame:
    """Evicted calls with the archive record that has their content: decisions that don't name it (archive_id) look for it in messages."""
    rows = decisions.filter(~F.col("action").isin(*KEEPS) & F.col("tool_use_id").isNotNull())
    columns = ["session_id", "tool_use_id", "tool", "action", "is_error", input_summary(F.col("input")).alias("about")]
    if "archive_id" in decisions.columns:
        return rows.select(*columns, "archive_id")
    rows = rows.select(*columns).distinct()
    ids = interactions(ledger(messages.join(rows.select("session_id").distinct(), "session_id", "left_semi"))).select("session_id", "tool_use_id", F.coalesce("result_id", "use_id").alias("archive_id"))
    return rows.join(ids, ["session_id", "tool_use_id"])


def _parts(messages: DataFrame) -> DataFrame:
    """A row for each message (kind 0), each of its uses (1) and of its results (2); what a message without one of the arrays has stays in its row."""
    uses, results = F.col("tool_uses").cast(f"array<{TOOL_USE}>"), F.col("tool_results").cast(f"array<{TOOL_RESULT}>")
    whole = F.col("tool_uses").isNull() | F.col("tool_results").isNull()
    no = lambda kind: F.lit(None).cast(kind)

    def part(kind: int, pos: Column, id: Column, use: Column, result: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), id.alias("tool_use_id"), use.alias("use"), result.alias("result"))

    head = F.array(part(0, F.lit(0), no("string"), no(TOOL_USE), no(TOOL_RESULT)))
    of_uses = F.transform(uses, lambda u, i: part(1, i, u["tool_use_id"], u, no(TOOL_RESULT)))
    of_results = F.transform(results, lambda r, i: part(2, i, r["tool_use_id"], no(TOOL_USE), r))
    own = F.struct("role", "text", whole.alias("whole"), F.when(whole, uses).alias("tool_uses"), F.when(whole, results).alias("tool_results"))
    rows = messages.select("*", F.monotonically_increasing_id().alias("row"))  # before the messages are taken apart
    rows = rows.select("session_id", "message_index", "row", own.alias("own"), F.inline(F.when(whole, head).otherwise(F.concat(head, of_uses, of_results))))
    return rows.withColumn("own", F.when(F.col("kind") == 0, F.col("own")))


def apply_actions(messages: DataFrame, decisions: DataFrame, config: EngineConfig) -> DataFrame:
    """The transcript after eviction: removed calls leave with their results, others keep a stub; emptied messages leave; runs of messages that are markers only become one."""
    gone = evictions(messages, decisions).select("session_id", "tool_use_id", F.struct("tool", "action", "is_error", "about", "archive_id").alias("d"))
    # Parts of messages meet the decisions in a window: all steps share one shuffle by session, of parts and decisions. Rows without an id are alone.
    rows = _parts(messages).unionByName(gone, allowMissingColumns=True).repartition("session_id")
    same = Window.partitionBy("session_id", "tool_use_id", F.when(F.col("tool_use_id").isNull(), F.col("row")))
    rows = rows.withColumn("d", F.max("d").over(same)).filter("kind is not null")
    d = F.col("d")
    drops = F.coalesce(d["action"].isin(*DROPS_CALL), F.lit(False))
    stubbed = lambda x: F.when(d.isNotNull(), stub(x["text"], d, config.head_chars)).otherwise(x["text"])
    use, result = F.col("use"), F.col("result")
    item = F.concat(F.trim(F.concat(d["tool"], F.lit(" "), d["about"])), F.lit(" -> "), d["archive_id"])
    in_order = lambda kind, x, name: F.transform(F.sort_array(F.collect_list(F.when(kind, F.struct("pos", x.alias("x"))))), lambda y: y["x"]).alias(name)
    is_use, is_result = F.col("kind") == 1, F.col("kind") == 2
    rows = rows.groupBy("session_id", "message_index", "row").agg(
        F.max("own").alias("own"),
        in_order(is_use & ~drops, use.withField("text", F.when(use["text"].isNotNull(), stubbed(use))), "tool_uses"),
        in_order(is_result & ~drops, result.withField("text", stubbed(result)), "tool_results"),
        in_order(is_use & drops, item, "items"),
        F.max(d.isNotNull()).alias("touched"),
    )
    blank = F.trim(F.regexp_replace("own.text", r"[\t-\r ]+", " ")) == ""
    rows = rows.select(
        "session_id",
        "message_index",
        "own.role",
        "own.text",
        F.when(F.col("own.whole"), F.col("own.tool_uses")).otherwise(F.col("tool_uses")).alias("tool_uses"),
        F.when(F.col("own.whole"), F.col("own.tool_results")).otherwise(F.col("tool_results")).alias("tool_results"),
        "items",
        blank.alias("blank"),
        "touched",
    )
    if not config.mark_removed:
        rows = rows.withColumn("items", F.array().cast("array<string>"))
    nothing = F.col("touched") & F.col("blank") & (F.size("tool_uses") == 0) & (F.size("tool_results") == 0)
    rows = rows.withColumn("only", nothing & (F.size("items") > 0)).filter(~nothing | F.col("only"))
    order = Window.partitionBy("session_id").orderBy("message_index")
    starts = F.when(F.col("only") & F.coalesce(F.lag("only").over(order), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("island", F.sum(starts).over(order))
    # A column each, so that what nobody asks for isn't carried.
    first = lambda name: F.min_by(name, "message_index").alias(name)
    merged = rows.groupBy("session_id", "island").agg(
        F.min("message_index").alias("message_index"),
        *[first(c) for c in ("role", "text", "tool_uses", "tool_results", "blank")],
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "items"))), lambda x: x["items"])).alias("items"),
    )
    note = marker(F.col("items"))
    text = F.when(F.size("items") == 0, F.col("text")).when(F.col("blank"), note).otherwise(F.concat(F.col("text"), F.lit("\n\n"), note))
    return merged.select("session_id", "message_index", "role", text.alias("text"), "tool_uses", "tool_results")


def archive_rows(events: DataFrame, decisions: DataFrame, compaction_id: str, archived_at: str) -> DataFrame:
    """Records of what leaves: every evicted call's result, and its use too where the call leaves as well."""
    gone = decisions.filter(~F.col("action").isin(*KEEPS)).groupBy("session_id", "tool_use_id").agg(F.max_by(F.struct("tool", "input", "action", "codes", "duplicate_of", "result_chars"), "call_seq").alias("d"))
    pairs = events.filter("kind in ('tool_use', 'tool_result')")
    last = Window.partitionBy("session_id", "tool_use_id", "kind").orderBy(F.col("seq").desc())
    pairs = pairs.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")
    both = Window.partitionBy("session_id", "tool_use_id")
    other = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("event_id"))).over(both)
    pairs = pairs.withColumn("use_id", other("tool_use")).withColumn("result_id", other("tool_result"))
    rows = pairs.join(gone, ["session_id", "tool_use_id"]).filter((F.col("kind") == "tool_result") | F.col("d.action").isin(*DROPS_CALL))
    of_result = F.col("kind") == "tool_result"
    related = F.when(of_result, F.array(F.struct(F.lit("call").alias("relation"), F.col("use_id").alias("id")))).when(F.col("result_id").isNotNull(), F.array(F.struct(F.lit("result").alias("relation"), F.col("result_id").alias("id")))).otherwise(F.array().cast("array<struct<relation: string, id: string>>"))
    metadata = F.to_json(F.struct(F.col("d.tool").alias("tool"), F.col("d.input").alias("input"), F.col("d.duplicate_of").alias("duplicateOf"), F.when(of_result, F.col("d.result_chars")).alias("resultChars"), (F.col("d.action") == "RERUN_ON_DEMAND").alias("rerun")))
    return rows.select(
        F.col("event_id").alias("id"),
        "session_id",
        "seq",
        "role",
        "kind",
        "content",
        "content_hash",
        "token_estimate",
        F.col("d.tool").alias("tool_name"),
        "tool_use_id",
        "is_error",
        F.lit(archived_at).alias("archived_at"),
        F.lit(compaction_id).alias("compaction_id"),
        F.col("d.action").alias("action"),
        F.transform("d.codes", lambda c: F.struct(c.alias("code"), F.lit("").alias("detail"))).alias("reasons"),
        related.alias("related"),
        metadata.alias("metadata"),
    )


def structure_faults(messages: DataFrame) -> DataFrame:
    """Results whose use isn't there, or comes later: session_id, message_index, tool_use_id."""
    uses = messages.select("session_id", F.col("message_index").alias("use_index"), F.explode("tool_uses").alias("u")).select("session_id", "use_index", F.col("u.tool_use_id").alias("tool_use_id"))
    first = uses.groupBy("session_id", "tool_use_id").agg(F.min("use_index").alias("use_index"))
    results = messages.select("session_id", "message_index", F.explode("tool_results").alias("r")).select("session_id", "message_index", F.col("r.tool_use_id").alias("tool_use_id"))
    return results.join(first, ["session_id", "tool_use_id"], "left").filter("use_index is null or use_index > message_index").drop("use_index")


def without_orphans(messages: DataFrame) -> DataFrame:
    """Messages without the results whose use isn't among them (before or in the same message)."""
    faults = structure_faults(messages).groupBy("session_id", "message_index").agg(F.collect_set("tool_use_id").alias("_stray"))
    rows = messages.join(faults, ["session_id", "message_index"], "left")
    kept = F.filter("tool_results", lambda r: ~F.array_contains("_stray", r["tool_use_id"]))
    return rows.withColumn("tool_results", F.when(F.col("_stray").isNull(), F.col("tool_results")).otherwise(kept)).drop("_stray")


def rechained(messages: DataFrame) -> DataFrame:
    """Messages without those that say nothing, numbered anew without gaps."""
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t-\r ]+", " ")) == ""
    rows = messages.filter(~(blank & (F.size("tool_uses") == 0) & (F.size("tool_results") == 0)))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("message_index")) - 1
    return rows.withColumn("message_index", place.cast("int"))


def with_notes(messages: DataFrame, report: DataFrame, compaction_id: str, at: str) -> DataFrame:
    """Messages with a user's message after the first of each session of report, which tells what was compacted; later ones move down by one."""
    removed = F.col("archive_only") + F.col("drop_redundant")
    units = F.concat(removed.cast("string"), F.when(removed == 1, F.lit(" tool interaction")).otherwise(F.lit(" tool interactions")))
    fewer = F.round(100 * F.col("reduction")).cast("int").cast("string")
    note = F.concat(
        F.lit(f"[compaction {compaction_id} at {at}] "), units, F.lit(" left this conversation and are archived word for word; nothing was paraphrased. Tokens: about "),
        F.col("tokens_before").cast("string"), F.lit(" before, "), F.col("tokens_after").cast("string"), F.lit(" after ("), fewer, F.lit("% fewer). Stubs and markers name the records (e_...) that bring the rest back."),
    )
    told = report.select("session_id", F.lit(1).alias("message_index"), F.lit("user").alias("role"), note.alias("text"), F.array().cast(f"array<{TOOL_USE}>").alias("tool_uses"), F.array().cast(f"array<{TOOL_RESULT}>").alias("tool_results"))
    noted = report.select("session_id", F.lit(1).alias("_moved"))
    first = F.min("message_index").over(Window.partitionBy("session_id"))
    rows = messages.join(noted, "session_id", "left").withColumn("message_index", F.when(F.col("message_index") > first, F.col("message_index") + F.coalesce("_moved", F.lit(0))).otherwise(F.col("message_index"))).drop("_moved")
    return rows.unionByName(told)


def rendered(messages: DataFrame, most_result: int = 20_000, most: int = 600_000) -> DataFrame:
    """Messages as text for a reader: session_id, message_index, line; results are cut to most_result characters, and the oldest messages to a note once newer ones fill most."""
    cut = lambda x: F.when(F.length(x) <= most_result, x).otherwise(F.concat(F.substring(x, 1, most_result), F.lit("\n[... "), (F.length(x) - most_result).cast("string"), F.lit(" more chars]")))
    uses = F.transform("tool_uses", lambda u: F.concat(F.lit("[call "), u["tool_use_id"], F.lit(": "), u["tool"], F.lit(" "), u["input"], F.lit("]")))
    results = F.transform("tool_results", lambda r: F.concat(F.lit("[result "), r["tool_use_id"], F.lit(": "), cut(F.coalesce(r["text"], F.lit(""))), F.lit("]")))
    line = F.concat(F.col("role"), F.lit(": "), F.array_join(F.filter(F.concat(F.array(F.coalesce("text", F.lit(""))), uses, results), lambda x: x != ""), "\n"))
    newer = Window.partitionBy("session_id").orderBy(F.col("message_index").desc())
    rows = messages.select("session_id", "message_index", "role", line.alias("line")).withColumn("_upto", F.sum(F.length("line")).over(newer))
    note = F.concat(F.col("role"), F.lit(": [message of "), F.length("line").cast("string"), F.lit(" chars left out]"))
    return rows.select("session_id", "message_index", F.when(F.col("_upto") <= most, F.col("line")).otherwise(note).alias("line"))
