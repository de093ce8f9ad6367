"""Scores of calls, and the actions that follow from them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PolicyOptions, RulesetOptions, clamp
from ..functions.text import FAILURE_WORD, paths_in
from .rules import EDITING_RULESET

#: Characters from which a result is large.
LARGE = 20_000
# Of the ruleset, tools that aren't reproducible.
NON_REPRODUCIBLE = ("WebFetch", "WebSearch", "Agent", "Task")
ACTIONS = ("PIN_VERBATIM", "KEEP_VERBATIM", "KEEP_HEAD_TAIL", "EXTRACT_MEMORY_AND_ARCHIVE", "ARCHIVE_ONLY", "REPLACE_WITH_REFERENCE", "RERUN_ON_DEMAND", "DROP_REDUNDANT")
DROPS_CALL = ("ARCHIVE_ONLY", "DROP_REDUNDANT")


class Scorer(Protocol):
    """Gives calls two columns, keep_call and keep_result, null where it has no answer."""

    default_threshold: float

    def score(self, calls: DataFrame) -> DataFrame: ...


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0))))


def recent_paths(messages: DataFrame, newest: int = 6) -> DataFrame:
    """Per session, the paths that its newest messages' whole texts mention; `newest` is what the ruleset calls recent."""
    age = Window.partitionBy("session_id").orderBy(F.col("message_index").desc())
    recent = messages.select("session_id", "text", F.row_number().over(age).alias("age")).filter(F.col("age") <= newest)
    return recent.groupBy("session_id").agg(F.array_distinct(F.flatten(F.collect_list(paths_in(F.col("text"))))).alias("recent_paths"))


def _mentions(text: Column, paths: Column) -> Column:
    """Whether a text has one of the paths anywhere: paths are taken from it only where the letters of one are in it."""
    # The text is normalised once, as the one element of an array, not for each path.
    plain = F.array(F.lower(F.when(F.contains(text, F.lit("\\")), F.translate(text, "\\", "/")).otherwise(text)))
    letters = F.when(F.size(paths) > 0, F.exists(plain, lambda x: F.exists(paths, lambda p: F.contains(x, p))))
    return F.when(letters, F.arrays_overlap(paths_in(text), paths)).otherwise(F.lit(False))


#: What the ruleset reads in results.
READINGS = ("_failed", "_mentioned")


def with_readings(calls: DataFrame, messages: DataFrame | None) -> DataFrame:
    """calls with READINGS: whether a Bash result has a word for a failure, and whether a result mentions a path of the session's newest messages."""
    calls = calls.withColumn("_failed", (F.col("tool") == "Bash") & F.col("result").rlike(FAILURE_WORD))
    if messages is None:
        return calls.withColumn("_mentioned", F.lit(False))
    return calls.join(recent_paths(messages), "session_id", "left").withColumn("_mentioned", _mentions(F.col("result"), F.col("recent_paths"))).drop("recent_paths")


class RulesetScorer:
    """Deterministic scores from tool, age, errors, repetition and size: column expressions only, over calls with their facts (and with their readings, or results are read here)."""

    default_threshold = 0.4

    def __init__(self, options: RulesetOptions | None = None):
        self.options = options or RulesetOptions()

    def score(self, calls: DataFrame, messages: DataFrame | None = None) -> DataFrame:
        o, tool = self.options, F.col("tool")
        kind = F.when(tool.isin(*o.rerunnable), F.lit("rerun")).when(tool.isin(*EDITING_RULESET), F.lit("edit")).when(tool == "Bash", F.lit("bash")).when(tool.isin(*NON_REPRODUCIBLE), F.lit("once")).otherwise(F.lit("other"))
        base = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), kind)
        # Keep probabilities by kind of tool.
        keep_call = base({"rerun": 0.4, "edit": 0.7, "bash": 0.5, "once": 0.5, "other": 0.5})
        keep_result = base({"rerun": 0.25, "edit": 0.3, "bash": 0.45, "once": 0.7, "other": 0.4})
        known = set(READINGS) <= set(calls.columns)
        calls = calls if known else with_readings(calls, messages)
        short = (F.col("result_chars") < 200) & ~F.col("is_error")
        keep_result = F.when(F.col("_failed"), F.lit(0.7)).when((tool == "Bash") & short, F.lit(0.2)).otherwise(keep_result)
        keep_result = F.when(F.col("is_error"), F.when(F.col("resolved_raw"), F.lit(0.2)).otherwise(F.lit(0.75))).otherwise(keep_result)
        age = F.greatest(F.lit(0), F.col("total") - 1 - F.col("result_index"))
        scale = 0.5 + 0.5 * unit(1 - age / F.lit(float(max(1, o.stale_after))))
        again = F.col("superseded")
        keep_call, keep_result = keep_call * scale * F.when(again, 0.5).otherwise(1.0), keep_result * scale * F.when(again, 0.3).otherwise(1.0)
        keep_result = keep_result + F.when(F.col("_mentioned"), 0.2).otherwise(0.0)
        keep_result = F.when(F.col("result_chars") > LARGE, F.greatest(F.lit(0.05), keep_result - 0.1)).otherwise(keep_result)
        scored = calls.withColumn("keep_call", unit(keep_call)).withColumn("keep_result", unit(keep_result))
        return scored if known else scored.drop(*READINGS)


class ReplayScorer:
    """Scores from a table of recorded answers: session_id, tool_use_id, keep_call, keep_result.

    With strict, a call without an answer is an error; otherwise it has no
    scores, and the policy keeps it.
    """

    default_threshold = 0.35

    def __init__(self, answers: DataFrame, strict: bool = False):
        self.answers, self.strict = answers, strict

    def score(self, calls: DataFrame) -> DataFrame:
        valid = lambda c: F.when(F.col(c).between(0, 1), F.col(c))
        answers = self.answers.select("session_id", "tool_use_id", valid("keep_call").alias("keep_call"), valid("keep_result").alias("keep_result"))
        rows = calls.join(answers, ["session_id", "tool_use_id"], "left")
        if self.strict:
            missing = F.raise_error(F.concat(F.lit("no recorded answer for "), F.col("tool_use_id"))).cast("double")
            rows = rows.withColumn("keep_call", F.coalesce("keep_call", missing))
        return rows


def request_hash(calls: DataFrame) -> DataFrame:
    """calls with request_hash: of what a scorer is asked about a call, without its session or place."""
    return calls.withColumn("request_hash", F.sha2(F.to_json(F.struct("tool", "canonical_input", "result", "is_error")), 256))


class Cassette:
    """Recorded answers by request hash, in a table: request_hash, keep_call, keep_result."""

    SCHEMA = "request_hash string, keep_call double, keep_result double"

    def __init__(self, answers: DataFrame):
        if missing := {"request_hash", "keep_call", "keep_result"} - set(answers.columns):
            raise ValueError(f"a cassette needs {', '.join(sorted(missing))}")
        self.answers = answers.select("request_hash", F.col("keep_call").cast("double").alias("keep_call"), F.col("keep_result").cast("double").alias("keep_result"))

    @classmethod
    def record(cls, scored: DataFrame) -> Cassette:
        """The answers of scored calls; equal requests have one."""
        return cls(request_hash(scored).groupBy("request_hash").agg(F.max("keep_call").alias("keep_call"), F.max("keep_result").alias("keep_result")))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cassette:
        return cls(spark.read.schema(cls.SCHEMA).json(path, mode="FAILFAST"))

    def save(self, path: str) -> None:
        self.answers.write.mode("overwrite").json(path)

    def scorer(self, calls: DataFrame, strict: bool = False) -> ReplayScorer:
        """A scorer for calls that replays this cassette."""
        return ReplayScorer(request_hash(calls).join(self.answers, "request_hash").select("session_id", "tool_use_id", "keep_call", "keep_result").dropDuplicates(["session_id", "tool_use_id"]), strict)


def decide(calls: DataFrame, options: PolicyOptions | None = None) -> DataFrame:
    """calls with action, codes (of the reasons) and confidence.

    calls has its facts, protections, duplicate_of, weak, keep_call and keep_result; the
    first rule that applies wins, and whatever is in doubt stays.
    """
    o = options or PolicyOptions()
    threshold = clamp(o.threshold)
    floor = max(0.0, threshold - clamp(o.margin))
    boosted = F.coalesce(F.col("weak"), F.lit(0)) > 0
    result = unit(F.col("keep_result") + F.when(boosted, o.boost).otherwise(0.0))
    call = unit(F.col("keep_call"))
    boost = F.when(boosted, F.array(F.lit("referenced_weakly"))).otherwise(F.array().cast("array<string>"))
    by_result = F.concat(F.array(F.lit("classifier_result")), boost)
    by_both = F.concat(by_result, F.array(F.lit("classifier_call")))
    rerun = F.col("tool").isin(*o.rerunnable) & ~F.col("changed_later")

    def verdict(action: str, codes: Column, confidence: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), codes.cast("array<string>").alias("codes"), unit(confidence.cast("double")).alias("confidence"))

    codes = lambda *names: F.array(*[F.lit(n) for n in names])
    duplicate = F.col("duplicate_of").isNotNull() if o.drop_redundant else F.lit(False)
    out = (
        F.when(F.col("pinned"), verdict("PIN_VERBATIM", codes("pinned_window"), F.lit(1)))
        .when(F.size("protections") > 0, verdict("KEEP_VERBATIM", F.col("protections"), F.lit(1)))
        .when(duplicate, verdict("DROP_REDUNDANT", codes("duplicate"), F.lit(1)))
        .when(F.col("keep_result").isNull() | F.col("keep_call").isNull(), verdict("KEEP_VERBATIM", codes("unscored"), F.lit(0)))
        .when(result >= threshold, verdict("KEEP_VERBATIM", by_result, result))
        .when(result >= floor, verdict("KEEP_VERBATIM", F.concat(by_result, codes("safety_margin")), threshold - result))
        .when((call >= floor) & rerun, verdict("RERUN_ON_DEMAND", F.concat(by_both, codes("rerunnable")), 1 - result))
        .when(call >= floor, verdict("KEEP_HEAD_TAIL", by_both, 1 - result))
        .otherwise(verdict("ARCHIVE_ONLY", by_both, F.least(1 - result, 1 - call)))
    )
    return calls.withColumn("v", out).select("*", "v.*").drop("v")


def decide_ancestor(calls: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The plain three-way pruner: keep, drop_result or drop_call by two probabilities, without rules or archive."""
    keep = F.col("pinned") | F.col("keep_result").isNull() | (F.col("keep_result") >= threshold)
    return calls.withColumn("action", F.when(keep, "keep").when(F.col("keep_call") >= threshold, "drop_result").otherwise("drop_call"))


def apply_ancestor(messages: DataFrame, decisions: DataFrame, head: int = 300) -> DataFrame:
    """The transcript after the three-way pruner: dropped calls leave with their results, dropped results keep a head and a note, emptied messages leave."""
    of_call = decisions.filter("action <> 'keep'").groupBy("session_id", "tool_use_id").agg(F.min("action").alias("action"))
    ids = F.array_distinct(F.concat(F.transform("tool_uses", lambda u: u["tool_use_id"]), F.transform("tool_results", lambda r: r["tool_use_id"])))
    wanted = messages.select("session_id", "message_index", F.explode(ids).alias("tool_use_id")).join(of_call, ["session_id", "tool_use_id"])
    found = wanted.groupBy("session_id", "message_index").agg(F.map_from_entries(F.collect_list(F.struct("tool_use_id", "action"))).alias("d"))
    rows = messages.join(found, ["session_id", "message_index"], "left")
    action = lambda x: F.coalesce(F.try_element_at("d", x["tool_use_id"]), F.lit("keep"))

    def cut(text: Column, is_error: Column) -> Column:
        top = F.concat(F.substring(text, 1, head), F.lit("\n")) if head > 0 else F.lit("")
        note = F.concat(F.lit("[truncated "), (F.length(text) - head).cast("string"), F.lit(" chars of this tool result"), F.when(is_error, F.lit(" (error)")).otherwise(F.lit("")), F.lit("; re-run the tool if needed]"))
        return F.when(F.length(text) <= head + 120, text).otherwise(F.concat(top, note))

    uses = F.transform(F.filter("tool_uses", lambda u: action(u) != "drop_call"), lambda u: u.withField("text", F.when(action(u) == "drop_result", cut(u["text"], F.coalesce(u["is_error"], F.lit(False)))).otherwise(u["text"])))
    results = F.transform(F.filter("tool_results", lambda r: action(r) != "drop_call"), lambda r: r.withField("text", F.when(action(r) == "drop_result", cut(F.coalesce(r["text"], F.lit("")), F.coalesce(r["is_error"], F.lit(False)))).otherwise(r["text"])))
    touched = F.col("d").isNotNull()
    rows = rows.withColumn("tool_uses", F.when(touched, uses).otherwise(F.col("tool_uses"))).withColumn("tool_results", F.when(touched, results).otherwise(F.col("tool_results")))
    emptied = touched & (F.trim(F.regexp_replace("text", r"[\t-\r ]+", " ")) == "") & (F.size("tool_uses") == 0) & (F.size("tool_results") == 0)
    return rows.filter(~emptied).drop("d")


def ancestor_stats(before: DataFrame, after: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per session: messages and characters before and after, and calls by action."""

    def size(messages: DataFrame, name: str) -> DataFrame:
        return messages.groupBy("session_id").agg(F.count("*").alias(f"messages_{name}"), F.sum(_chars()).alias(f"chars_{name}"))

    actions = decisions.groupBy("session_id").agg(F.count("*").alias("calls"), *[F.count_if(F.col("action") == a).alias(a) for a in ("keep", "drop_result", "drop_call")])
    return size(before, "before").join(size(after, "after"), "session_id", "left").join(actions, "session_id", "left").na.fill(0)


def _chars() -> Column:
    uses = F.aggregate("tool_uses", F.lit(0).cast("long"), lambda n, u: n + F.length(u["input"]))
    results = F.aggregate("tool_results", F.lit(0).cast("long"), lambda n, r: n + F.length(F.coalesce(r["text"], F.lit(""))))
    return F.length("text") + uses + results


def decision_lines(decisions: DataFrame) -> DataFrame:
    """A line for each decision, as a log has it: session_id, call_seq, line."""
    score = lambda c: F.coalesce(F.format_number(F.col(c), 2), F.lit("-"))
    line = F.concat_ws(" ", F.col("tool_use_id"), F.col("tool"), F.col("action"), F.array_join("codes", ","), F.concat(F.lit("call="), score("keep_call")), F.concat(F.lit("result="), score("keep_result")))
    return decisions.select("session_id", "call_seq", line.alias("line"))


def action_counts(decisions: DataFrame) -> DataFrame:
    """Per session, how many calls have each action; actions that never occur count 0."""
    return decisions.groupBy("session_id").agg(F.count("*").alias("calls"), *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ACTIONS])


def reason_counts(decisions: DataFrame) -> DataFrame:
    """Per session and reason, how many calls were decided for it: session_id, reason, calls."""
    return decisions.select("session_id", F.explode("codes").alias("reason")).groupBy("session_id", "reason").agg(F.count("*").alias("calls"))


def suspect_calibration(decisions: DataFrame, least: int = 5) -> DataFrame:
    """Sessions of which at least so many calls were scored and none kept for its score, with the best score."""
    scored = F.exists("codes", lambda c: c.startswith("classifier_"))
    rows = decisions.filter(scored).groupBy("session_id").agg(F.count("*").alias("scored"), F.count_if(F.col("action") == "KEEP_VERBATIM").alias("kept"), F.max("keep_result").alias("best"))
    return rows.filter((F.col("scored") >= least) & (F.col("kept") == 0)).select("session_id", "scored", "best")


def apply_review(scores: DataFrame, keeps: DataFrame) -> DataFrame:
    """scores with 1 for the calls a reviewer wants kept (session_id, tool_use_id)."""
    marked = keeps.select("session_id", "tool_use_id").distinct().withColumn("_keep", F.lit(True))
    rows = scores.join(marked, ["session_id", "tool_use_id"], "left")
    forced = lambda c: F.when(F.col("_keep"), F.lit(1.0)).otherwise(F.col(c))
    return rows.withColumn("keep_call", forced("keep_call")).withColumn("keep_result", forced("keep_result")).drop("_keep")
