"""Transcripts from JSON lines: one file per session, records linked to their parents.

Files are split like any text: a record's place is its split's offset in the
file and its number in the split, so a file is many tasks' work.  A line is
parsed by itself; what hangs together between lines (the main chain, messages
of several records, results of tool uses) is joins and windows over light rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.redaction import leaves_of, redact_messages, with_leaves
from ..operators.chains import main_chains
from ..operators.ordered import previous, running_sum
from ..schema import TOOL_RESULT, TOOL_USE
from ..storage import ready, table
from .datasets import decoded

_REMINDER = re.compile(r"<system-reminder>.*?</system-reminder>", re.DOTALL)
#: Types of records that can be messages; all others are counted only.
SPEAKERS, ATTACHMENT = ("user", "assistant"), "attachment"


@dataclass(frozen=True)
class LoadOptions:
    """redact is True for secrets by session (and user_paths), or a function of one text that is called for every text and every string of an input."""

    sidechains: bool = False
    attachments: bool = False
    thinking: bool = False
    strip_reminders: bool = True
    redact: bool | Callable[[str], str] = False
    user_paths: bool = False


def flat(content) -> str:
    """Text of a content that is a string or a list of blocks."""
    if isinstance(content, str):
        return content
    parts = []
    for b in content if isinstance(content, list) else []:
        if isinstance(b, str):
            parts.append(b)
        elif isinstance(b, dict) and b.get("type") == "text":
            parts.append(str(b.get("text", "")))
        elif isinstance(b, dict) and b.get("type") == "image":
            parts.append("[image]")
        elif isinstance(b, dict) and b.get("type") == "tool_result":
            parts.append(flat(b.get("content")))
    return "\n".join(x for x in parts if x)


_COUNTS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
_USED = ", ".join(f"{c}: bigint" for c in _COUNTS) + ", model: string, timestamp: string"
_RECORD = f"file string, block long, at long, error boolean, type string, uuid string, parent string, session string, sidechain boolean, mid string, compact boolean, text string, thinking string, uses array<{TOOL_USE}>, results array<{TOOL_RESULT}>, usage struct<{_USED}>"


def _string(value) -> str | None:
    return value if isinstance(value, str) else None


def parse_line(line: str, options: LoadOptions) -> dict | None:
    """What one line says, without its place; None for a blank line."""
    if not line.strip():
        return None
    try:
        record = json.loads(line)
    except ValueError:
        record = None
    if not isinstance(record, dict):
        return {"error": True}
    kind = str(record.get("type") or "unknown")
    out = {"error": False, "type": kind, "uuid": _string(record.get("uuid")), "parent": _string(record.get("parentUuid")) or None, "session": _string(record.get("sessionId")) or None, "sidechain": record.get("isSidechain") is True, "compact": record.get("isCompactSummary") is True}
    hide = options.redact if callable(options.redact) else str
    strip = (lambda t: _REMINDER.sub("", t)) if options.strip_reminders else str
    if kind == ATTACHMENT:
        given = [x.get("content") for x in record.get("rendered") or [] if isinstance(x, dict)]
        return out | {"text": hide(strip("\n\n".join(x for x in given if isinstance(x, str) and x)))}
    if kind not in SPEAKERS:
        return out
    inner = record["message"] if isinstance(record.get("message"), dict) else {}
    texts, thoughts, uses, results = [], [], [], []
    content = inner.get("content")
    for b in [{"type": "text", "text": content}] if isinstance(content, str) else content if isinstance(content, list) else []:
        what = b.get("type") if isinstance(b, dict) else None
        if what == "text":
            texts.append(_string(b.get("text")) or "")
        elif what == "thinking" and options.thinking and kind == "assistant":
            thoughts.append(_string(b.get("thinking")) or "")
        elif what == "tool_use" and kind == "assistant" and isinstance(b.get("id"), str) and isinstance(b.get("name"), str):
            value = b.get("input") if isinstance(b.get("input"), dict | list) else {}
            value = with_leaves(value, map(hide, leaves_of(value)))
            uses.append({"tool_use_id": b["id"], "tool": b["name"], "input": json.dumps(value, ensure_ascii=False, separators=(",", ":")), "text": None, "is_error": None})
        elif what == "tool_result" and kind == "user":
            results.append({"tool_use_id": _string(b.get("tool_use_id")) or "", "text": hide(flat(b.get("content"))), "is_error": b.get("is_error") is True})
        elif what == "image":
            texts.append("[image]")
    text = "\n".join(t for t in texts if t)
    used = inner.get("usage")
    usage = {c: int(used.get(c) or 0) for c in _COUNTS} | {"model": _string(inner.get("model")), "timestamp": _string(record.get("timestamp"))} if isinstance(used, dict) and kind == "assistant" else None
    return out | {"mid": _string(inner.get("id")), "text": hide(strip(text) if kind == "user" else text), "thinking": hide("\n".join(x for x in thoughts if x)), "uses": uses, "results": results, "usage": usage}


@dataclass
class Transcripts:
    """messages; usage, a row per call of the model; compactions, the messages that sum up what was before them; skipped, counts by reason; files, the file and session_id of each."""

    messages: DataFrame
    usage: DataFrame
    compactions: DataFrame
    skipped: DataFrame
    files: DataFrame


def read_records(spark: SparkSession, path: str | list[str], options: LoadOptions) -> DataFrame:
    """All lines under path, parsed, with their places; written, so that places stay."""
    ready(spark)
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    schema = to_arrow_schema(StructType.fromDDL(_RECORD))

    def run(batches):
        for b in batches:
            rows = [(parse_line(line, options), place) for line, *place in zip(*(c.to_pylist() for c in b.columns))]
            made = [r | dict(zip(("file", "block", "at"), place)) for r, place in rows if r is not None]
            yield from pa.Table.from_pylist(made, schema=schema).to_batches()

    return table(lines.mapInArrow(run, _RECORD), "transcript-records")


def chained(records: DataFrame, options: LoadOptions) -> tuple[DataFrame, DataFrame]:
    """The records that make up each file's transcript, in the order of stretch and at, and the files whose chain is broken.

    That is the main chain from the last user's or assistant's record; in a
    file where it has a cycle or a lost parent, all of its records.
    """
    out = F.lit(False) if options.sidechains else F.col("sidechain")
    leaf = F.col("type").isin(*SPEAKERS) & ~out
    light = records.filter("not error").select("file", "block", "at", "uuid", "parent", "type", "mid", "sidechain", (leaf & F.col("uuid").isNotNull()).alias("leaf"))
    chains = main_chains(light, "file")
    broken = table(chains.broken.join(light.filter("leaf").select("file").distinct(), "file", "left_semi"), "transcript-broken")
    others = light.filter(~out & F.col("type").isin(*SPEAKERS, ATTACHMENT)).join(broken, "file", "left_semi").withColumn("stretch", F.col("block"))
    return table(light.join(chains.chain, ["file", "block", "at"]).unionByName(others), "transcript-chain"), broken


def read_transcripts(spark: SparkSession, path: str | list[str], options: LoadOptions | None = None) -> Transcripts:
    """Transcripts under a path, or several, a file each. Its lines are parsed once and its messages written, when this is called."""
    options = options or LoadOptions()
    records = read_records(spark, path, options)
    chain, broken = chained(records, options)

    # Records that go into one message: assistants' in a row with one message id. Left out ones end a message.
    left_out = F.col("sidechain") & F.lit(not options.sidechains) | ~F.col("type").isin(*SPEAKERS, *([ATTACHMENT] if options.attachments else []))
    before = previous(chain, ["file"], "stretch", "at", F.struct("type", "mid", left_out.alias("out")), "before")
    again = (F.col("type") == "assistant") & (F.col("before.type") == "assistant") & F.col("mid").eqNullSafe(F.col("before.mid")) & ~left_out & ~F.col("before.out")
    grouped = running_sum(before, ["file"], "stretch", "at", F.when(F.coalesce(again, F.lit(False)), 0).otherwise(1), "g").filter(~left_out).select("file", "block", "at", "stretch", "g")
    parts = grouped.join(records.select("file", "block", "at", "type", "compact", "text", "thinking", "uses", "results", "usage"), ["file", "block", "at"])
    listed = F.array_sort(F.collect_list(F.struct("stretch", "at", "type", "compact", "text", "thinking", "uses", "results", "usage")))
    whole = parts.groupBy("file", "g").agg(listed.alias("p"))
    joined = lambda c: F.array_join(F.filter(F.transform("p", lambda x: x[c]), lambda t: t != ""), "\n")
    inner = lambda c, kind: F.flatten(F.transform("p", lambda x: F.coalesce(x[c], F.array().cast(f"array<{kind}>"))))
    thought, said = joined("thinking"), joined("text")
    text = F.when(thought == "", said).otherwise(F.concat(F.lit("[thinking] "), thought, F.when(said == "", "").otherwise(F.concat(F.lit("\n"), said))))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    role = F.when(first["type"] == "assistant", "assistant").otherwise("user")
    whole = whole.select("file", "g", role.alias("role"), text.alias("text"), inner("uses", TOOL_USE).alias("tool_uses"), inner("results", TOOL_RESULT).alias("tool_results"), first["compact"].alias("compact"), last["usage"].alias("usage"))
    blank = (F.col("text") == "") & (F.size("tool_uses") == 0) & (F.size("tool_results") == 0)
    whole = running_sum(whole.withColumn("blank", blank).withColumn("tile", F.floor(F.col("g") / 4096)), ["file"], "tile", "g", F.when(F.col("blank"), 0).otherwise(1), "n")
    names = records.groupBy("file").agg(F.min_by("session", F.when(F.col("session").isNotNull(), F.struct("block", "at"))).alias("own"))
    names = table(names.select("file", F.coalesce("own", decoded(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))).alias("session_id")), "transcript-files")
    whole = table(whole.join(names, "file").withColumn("message_index", (F.col("n") - 1).cast("int")), "transcript-messages")

    # A use gets what the next result of its id says, unless the id is used again before that.
    used = whole.select("file", "g", F.posexplode("tool_uses").alias("pos", "u")).select("file", "g", "pos", F.col("u.tool_use_id").alias("id"), F.lit(False).alias("is_result"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("boolean").alias("e"))
    told = whole.select("file", "g", F.posexplode("tool_results").alias("pos", "r")).select("file", "g", "pos", F.col("r.tool_use_id").alias("id"), F.lit(True).alias("is_result"), F.col("r.text").alias("t"), F.col("r.is_error").alias("e"))
    following = F.lead(F.struct("is_result", "t", "e")).over(Window.partitionBy("file", "id").orderBy("g", "pos"))
    answers = used.unionByName(told).withColumn("a", following).filter("not is_result and a.is_result")
    answers = answers.groupBy("file", "g").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("a.t", "a.e")))).alias("answers"))
    filled = F.transform("tool_uses", lambda u, i: F.coalesce(u.withField("text", F.try_element_at("answers", i)["t"]).withField("is_error", F.try_element_at("answers", i)["e"]), u))
    messages = whole.filter("not blank").join(answers, ["file", "g"], "left").select("session_id", "message_index", "role", "text", filled.cast(f"array<{TOOL_USE}>").alias("tool_uses"), F.col("tool_results").cast(f"array<{TOOL_RESULT}>").alias("tool_results"))

    reason = lambda df, why: df.groupBy("file", why.alias("reason")).count()
    kept = F.col("type").isin(*SPEAKERS, ATTACHMENT)
    skipped = reason(records.filter("error"), F.lit("parse_error")).unionByName(reason(records.filter(~F.col("error") & ~kept), F.col("type")))
    skipped = skipped.unionByName(reason(broken, F.lit("orphan_chain"))).unionByName(reason(whole.filter("blank"), F.lit("empty")))
    if not options.sidechains:
        skipped = skipped.unionByName(reason(records.filter(kept & F.col("sidechain")), F.lit("sidechain")))
    if not options.attachments:
        skipped = skipped.unionByName(reason(chain.filter(F.col("type") == ATTACHMENT), F.col("type")))
    skipped = skipped.join(names, "file").groupBy("session_id", "reason").agg(F.sum("count").alias("count"))
    if options.redact is True:
        hidden = table(redact_messages(messages, user_paths=options.user_paths), "transcript-redacted")
        messages = messages.join(hidden.select("session_id").distinct(), "session_id", "left_anti").unionByName(hidden)
    usage = whole.filter("usage is not null").select("session_id", F.when(~F.col("blank"), F.col("message_index")).alias("message_index"), "usage.*")
    return Transcripts(messages, usage, whole.filter("compact and not blank").select("session_id", "message_index"), skipped, names)


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Files of transcripts, the largest first, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"), "path", F.col("length").alias("bytes")).orderBy(F.col("bytes").desc())


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")])


def write_messages(messages: DataFrame, path: str, compaction_id: str) -> None:
    """An exact snapshot by session, before anything is rewritten."""
    messages.withColumn("compaction_id", F.lit(compaction_id)).write.mode("append").partitionBy("session_id", "compaction_id").parquet(path)
