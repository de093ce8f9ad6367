"""Rules about tool calls: what must stay, what was superseded, what repeats.

All look back or forward within a session; each is a window over the columns it
needs, so a session costs one sort and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RuleOptions
from ..functions.text import content_hash

# Tools that edit, for the rules and for the ruleset.
EDITING = ("Edit", "Write", "MultiEdit", "NotebookEdit")
EDITING_RULESET = ("Edit", "Write", "MultiEdit")
# Cues of an instruction; the first in this order counts. Some end in a blank.
CUES = ("never", "must not", "mustn't", "do not", "don't", "not allowed", "forbidden", "prohibited", "always", "must ", "required", "only ", "make sure", "be careful", "under no circumstances")


def last_index(condition: Column, *partition: str) -> Column:
    """The largest call_index of the partition's rows for which condition holds."""
    return F.max(F.when(condition, F.col("call_index"))).over(Window.partitionBy("session_id", *partition))


def resolved_later(path: str) -> Column:
    """Whether a later call of the same tool succeeded: with the same command, or else path, or else any."""
    ok = ~F.col("is_error")
    target = F.when(F.col("command").isNotNull(), last_index(ok, "tool", "command")).when(F.col(path).isNotNull(), last_index(ok, "tool", path)).otherwise(last_index(ok, "tool"))
    return F.coalesce(target > F.col("call_index"), F.lit(False))


def unresolved_error() -> Column:
    return F.col("is_error") & ~resolved_later("path")


def target_changed_later() -> Column:
    """Whether a later call edits this call's file."""
    return F.col("path").isNotNull() & F.coalesce(last_index(F.col("tool").isin(*EDITING), "path") > F.col("call_index"), F.lit(False))


def superseded() -> Column:
    """Whether a later call has the same tool and input."""
    return last_index(F.lit(True), "tool", "canonical_input") > F.col("call_index")


def current_file(window: int) -> Column:
    """Whether a call that doesn't edit has a file that the newest messages edited."""
    recent = F.col("tool").isin(*EDITING) & (F.col("call_index") >= F.col("total") - window)
    return F.col("path").isNotNull() & ~F.col("tool").isin(*EDITING) & last_index(recent, "path").isNotNull()


def with_facts(calls: DataFrame, current_window: int) -> DataFrame:
    """calls with what looking around in the session tells, in one step: windows over the same columns are one operator, and all share the session's partitioning."""
    return calls.select(
        "*",
        resolved_later("path").alias("resolved"),
        resolved_later("raw_path").alias("resolved_raw"),
        target_changed_later().alias("changed_later"),
        superseded().alias("superseded"),
        current_file(current_window).alias("on_current_file"),
    )


def non_reproducible(tools: tuple[str, ...]) -> Column:
    whole = [t for t in tools if not t.endswith("*")]
    out = F.col("tool").isin(*whole) if whole else F.lit(False)
    for t in tools:
        if t.endswith("*"):
            out = out | F.col("tool").startswith(t[:-1])
    return out


def exact_duplicates(calls: DataFrame, least: int = 40) -> DataFrame:
    """calls with duplicate_of: the tool_use_id of the latest call with the same tool, input and result; null for that one, for short results and for pinned calls."""
    same = Window.partitionBy("session_id", "tool", "use_hash", "result_hash").orderBy("call_seq")
    rows = calls.withColumn("use_hash", content_hash(F.col("tool"), F.col("input"))).withColumn("result_hash", content_hash(F.col("result")))
    last = F.last("tool_use_id").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    older = F.lead("call_seq").over(same).isNotNull()
    return rows.withColumn("duplicate_of", F.when((F.col("result_chars") >= least) & ~F.col("pinned") & older, last)).drop("use_hash", "result_hash")


def with_protections(calls: DataFrame, options: RuleOptions, references: DataFrame | None = None) -> DataFrame:
    """calls with its facts, protections (names of rules, in order) and strong and weak references, if any are given by session_id and tool_use_id."""
    calls = with_facts(calls, options.current_window)
    rows = calls.join(references, ["session_id", "tool_use_id"], "left") if references is not None else calls.withColumn("strong", F.lit(0)).withColumn("weak", F.lit(0))
    rules = [
        ("unresolved_error", F.col("is_error") & ~F.col("resolved") if options.unresolved_errors else F.lit(False)),
        ("non_reproducible", non_reproducible(options.non_reproducible)),
        ("referenced_later", (F.coalesce(F.col("strong"), F.lit(0)) > 0) if options.referenced else F.lit(False)),
        ("current_file", F.col("on_current_file") if options.current_files else F.lit(False)),
        ("ambiguous_structure", F.col("ambiguous")),
    ]
    flags = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]
    return rows.withColumn("protections", F.filter(F.array(*flags), lambda x: x.isNotNull()))


def constraints(messages: DataFrame) -> DataFrame:
    """Sentences of users' texts that read as instructions: session_id, message_index, sentence, text, cue."""
    marked = F.regexp_replace("text", r"([.!?\n])[\t-\r ]+", "$1\u0000")
    rows = messages.filter("role = 'user'").select("session_id", "message_index", F.posexplode(F.split(marked, "\u0000")).alias("sentence", "raw"))
    lower = F.lower("raw")
    cue = F.coalesce(*[F.when(F.contains(lower, F.lit(c)), F.lit(c.strip())) for c in CUES])
    text = F.regexp_replace("raw", r"^[\t-\r ]+|[\t-\r ]+$", "")
    rows = rows.withColumn("cue", cue).withColumn("text", text).filter("cue is not null")
    return rows.filter(~F.col("text").startswith("```") & ~F.col("text").startswith(">")).select("session_id", "message_index", "sentence", F.substring("text", 1, 500).alias("text"), "cue")
